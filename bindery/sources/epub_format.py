"""EPUB files as bytes: metadata, spine, manifest, navigation, images, styles; and the writing of metadata. No Spark here."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile

DC, OPF, NCX = "{http://purl.org/dc/elements/1.1/}", "{http://www.idpf.org/2007/opf}", "{http://www.daisy.org/z3986/2005/ncx/}"


class EpubError(ValueError):
    pass


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise EpubError(str(e)) from None


def _package(z: zipfile.ZipFile) -> tuple[str, ET.Element]:
    name = next((n for n in z.namelist() if n.endswith(".opf")), None)
    if name is None:
        raise EpubError("no package file")
    try:
        return name, ET.fromstring(z.read(name))
    except ET.ParseError as e:
        raise EpubError(f"the package file can't be read: {e}") from None


def _text(root: ET.Element, tag: str) -> str:
    node = root.find(f".//{tag}")
    return (node.text or "").strip() if node is not None else ""


def metadata(data: bytes) -> dict:
    with _open(data) as z:
        _, root = _package(z)
    isbn = 0
    for node in root.iter(f"{DC}identifier"):
        digits = (node.text or "").lower().replace("urn:isbn:", "").replace("-", "").strip()
        if digits.isascii() and digits.isdigit() and int(digits) < 2**64 and ("isbn" in (node.get(f"{OPF}scheme", "") + (node.text or "")).lower() or len(digits) in (10, 13)):
            isbn = int(digits)
            break
    fields = {k: _text(root, DC + tag) for k, tag in (("title", "title"), ("author", "creator"), ("contributor", "contributor"), ("publisher", "publisher"), ("description", "description"), ("language", "language"), ("rights", "rights"), ("pub_date", "date"))}
    subjects = [(n.text or "").strip() for n in root.iter(f"{DC}subject")]
    return fields | {"isbn": isbn, "subject": subjects or None}


def manifest(data: bytes) -> list[tuple[int, str, str, str]]:
    """(ord, id, href, media_type)."""
    with _open(data) as z:
        _, root = _package(z)
    return [(i, n.get("id", ""), n.get("href", ""), n.get("media-type", "")) for i, n in enumerate(root.iter(f"{OPF}item"))]


def spine(data: bytes) -> list[tuple[int, str]]:
    """(pos, idref)."""
    with _open(data) as z:
        _, root = _package(z)
    return [(i, n.get("idref", "")) for i, n in enumerate(root.iter(f"{OPF}itemref"))]


def navigation(data: bytes) -> list[tuple[str, str, str]]:
    """(play_order, src, label) of the points at the top level."""
    with _open(data) as z:
        name = next((n for n in z.namelist() if n.endswith(".ncx")), None)
        if name is None:
            return []
        root = ET.fromstring(z.read(name))
    out = []
    for point in root.findall(f"{NCX}navMap/{NCX}navPoint"):
        content = point.find(f"{NCX}content")
        out.append((point.get("playOrder", ""), content.get("src") if content is not None else None, _text(point, f"{NCX}text")))
    return out


def documents(data: bytes) -> list[tuple[str, str]]:
    """(name, html) of the entries that the manifest calls XHTML, in the order of the archive."""
    wanted = [h for _, _, h, kind in manifest(data) if "html" in kind]
    with _open(data) as z:
        return [(n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if any(n.endswith(h) for h in wanted if h)]


def images(data: bytes) -> list[tuple[int, str, bytes]]:
    """(ord, name, content) of the JPEG entries of the manifest; the first archive entry that ends with the href."""
    wanted = [(i, h) for i, _, h, kind in manifest(data) if kind == "image/jpeg" and h]
    with _open(data) as z:
        names = z.namelist()
        found = ((i, next((n for n in names if n.endswith(h)), None)) for i, h in wanted)
        return [(i, n, z.read(n)) for i, n in found if n]


def stylesheet(data: bytes) -> str:
    with _open(data) as z:
        return "".join(z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.endswith(".css"))


def chapters(data: bytes) -> list[tuple[str | None, str, str]]:
    """(label or null, name, html) in the order of the spine; entries that the manifest lacks drop out."""
    hrefs = {i: h for _, i, h, _ in reversed(manifest(data))}
    labels: dict[str, str] = {}
    for order, src, label in sorted((x for x in navigation(data) if x[0].isdigit() and x[1]), key=lambda x: int(x[0])):
        labels.setdefault(posixpath.basename(src.split("#")[0]), label)
    by_name = dict(reversed(documents(data)))
    out, seen = [], set()
    for _, idref in spine(data):
        href = hrefs.get(idref)
        name = next((n for n in by_name if href and n.endswith(href)), None)
        if name and name not in seen:
            seen.add(name)
            out.append((labels.get(posixpath.basename(href)), name, by_name[name]))
    return out


def write(book: dict, parts: list[tuple[str | None, str]], pictures: list[bytes] = (), css: str = "") -> bytes:
    """An EPUB of (label or null, html) parts."""
    out = io.BytesIO()
    esc = lambda s: str(s or "").replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    items = [f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(parts))]
    items += [f'<item id="i{i}" href="images/{i}.jpg" media-type="image/jpeg"/>' for i in range(len(pictures))]
    if css:
        items.append('<item id="s" href="style.css" media-type="text/css"/>')
    dc = "".join(f"<dc:{tag}>{esc(book.get(k))}</dc:{tag}>" for k, tag in (("title", "title"), ("author", "creator"), ("publisher", "publisher"), ("description", "description"), ("language", "language"), ("pub_date", "date"), ("rights", "rights"), ("contributor", "contributor")) if book.get(k))
    dc += f"<dc:identifier>urn:isbn:{book['isbn']}</dc:identifier>" if book.get("isbn") else ""
    dc += "".join(f"<dc:subject>{esc(s)}</dc:subject>" for s in book.get("subject") or [])
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{dc}</metadata><manifest>{"".join(items)}</manifest><spine>{"".join(f"<itemref idref=%cc{i}%c/>" % (34, 34) for i in range(len(parts)))}</spine></package>'
    points = "".join(f'<navPoint playOrder="{i + 1}"><navLabel><text>{esc(label)}</text></navLabel><content src="text/c{i}.xhtml"/></navPoint>' for i, (label, _) in enumerate(parts) if label)
    ncx = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><docTitle><text>{esc(book.get("title"))}</text></docTitle><navMap>{points}</navMap></ncx>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/toc.ncx", ncx)
        for i, (_, html) in enumerate(parts):
            z.writestr(f"OEBPS/text/c{i}.xhtml", html)
        for i, picture in enumerate(pictures):
            z.writestr(f"OEBPS/images/{i}.jpg", picture)
        if css:
            z.writestr("OEBPS/style.css", css)
    return out.getvalue()


def rewrite_metadata(data: bytes, book: dict) -> bytes:
    """The same book with title, author (and its sorted form), publisher, date and ISBN changed, in the package and the navigation."""
    out = io.BytesIO()
    tags = {"title": "title", "author": "creator", "publisher": "publisher", "pub_date": "date"}
    with _open(data) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        package, root = _package(z)
        head = root.find(f"{OPF}metadata")
        for key, tag in tags.items():
            if book.get(key) is not None:
                node = head.find(DC + tag)
                node = ET.SubElement(head, DC + tag) if node is None else node
                node.text = str(book[key])
                if key == "author":
                    words = node.text.split(" ")
                    node.set(f"{OPF}file-as", node.text if len(words) == 1 else f"{words[-1]}, {' '.join(words[:-1])}")
        if book.get("isbn"):
            node = next((n for n in head.iter(f"{DC}identifier") if "isbn" in (n.text or "").lower()), None)
            node = ET.SubElement(head, f"{DC}identifier") if node is None else node
            node.text = f"urn:isbn:{book['isbn']}"
        for info in z.infolist():
            content = z.read(info)
            if info.filename == package:
                content = ET.tostring(root, xml_declaration=True, encoding="utf-8")
            elif info.filename.endswith(".ncx") and book.get("title") is not None:
                tree = ET.fromstring(content)
                node = tree.find(f"{NCX}docTitle/{NCX}text")
                if node is not None:
                    node.text = str(book["title"])
                content = ET.tostring(tree, xml_declaration=True, encoding="utf-8")
            new.writestr(info, content)
    return out.getvalue()
