"""MOBI files as bytes: headers, records, text, images; and the writing of them. No Spark here."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from bindery.functions.binary import HuffCdic, decompress_all, encode_vwi, palmdoc_compress_all, trim_trailing

#: EXTH record types of the metadata fields.
EXTH = {"author": 100, "publisher": 101, "description": 103, "isbn": 104, "subject": 105, "pub_date": 106, "contributor": 108, "rights": 109, "title": 503, "language": 524}
#: Offsets, from the start of the MOBI header, of the fields used here.
FIELDS = {
    "header_length": 4, "mobi_type": 8, "encoding": 12, "unique_id": 16, "version": 20, "first_non_text": 64, "title_offset": 68, "title_length": 72,
    "locale": 76, "min_version": 88, "first_image": 92, "huff_record": 96, "huff_count": 100, "exth_flags": 112, "drm_offset": 152, "extra_flags": 226,
}
#: Further fields of the MOBI header, four bytes each.
FURTHER_FIELDS = {
    "orth_index": 24, "infl_index": 28, "index_names": 32, "index_keys": 36, "extra_index_0": 40, "extra_index_1": 44, "extra_index_2": 48, "extra_index_3": 52,
    "extra_index_4": 56, "extra_index_5": 60, "input_language": 80, "output_language": 84, "huff_table_offset": 104, "huff_table_length": 108,
    "drm_count": 156, "drm_size": 160, "drm_flags": 164, "fcis_record": 184, "fcis_count": 188, "flis_record": 192, "flis_count": 196,
    "srcs_record": 208, "srcs_count": 212, "index_record": 228,
}
#: Fields of the PDB header and, from its own start, of the PalmDOC header.
PDB_FIELDS = {
    "attributes": (32, ">H"), "pdb_version": (34, ">H"), "created": (36, ">L"), "modified": (40, ">L"), "backed_up": (44, ">L"), "modification_number": (48, ">L"),
    "app_info_offset": (52, ">L"), "sort_info_offset": (56, ">L"), "uid_seed": (68, ">L"), "next_record_list": (72, ">L"),
}
PALMDOC_FIELDS = {"compression": (0, ">H"), "text_length": (4, ">L"), "text_records": (8, ">H"), "record_size": (10, ">H"), "encryption": (12, ">H")}
NULL = 0xFFFFFFFF


class MobiError(ValueError):
    pass


@dataclass
class Mobi:
    """The headers of a file; the text and images are read on demand."""

    data: bytes
    offsets: list[int]
    compression: int
    text_records: int
    text_length: int
    encryption: int
    fields: dict[str, int]
    title: str
    exth: dict[int, bytes] = field(default_factory=dict)
    pdb_name: str = ""

    def record(self, n: int) -> bytes:
        end = self.offsets[n + 1] if n + 1 < len(self.offsets) else len(self.data)
        return self.data[self.offsets[n] : end]

    def headers(self) -> dict[str, int]:
        """All numbers in the headers, by name."""
        at = self.offsets[0]
        pdb = {k: struct.unpack_from(kind, self.data, offset)[0] for k, (offset, kind) in PDB_FIELDS.items()}
        palmdoc = {k: struct.unpack_from(kind, self.data, at + offset)[0] for k, (offset, kind) in PALMDOC_FIELDS.items()}
        head, length = at + 16, self.fields["header_length"]
        further = {k: struct.unpack_from(">L", self.data, head + offset)[0] for k, offset in FURTHER_FIELDS.items() if offset + 4 <= length and head + offset + 4 <= len(self.data)}
        flags = {"has_exth": int(bool(self.fields["exth_flags"] & 0x40)), "has_drm": int(self.fields["drm_offset"] not in (0, NULL)), "records": len(self.offsets), "exth_records": len(self.exth)}
        return {**pdb, **palmdoc, **self.fields, **further, **flags}

    @property
    def codec(self) -> str:
        kind = self.fields["encoding"]
        if kind not in (1252, 65001):
            raise MobiError(f"unknown text encoding {kind}")
        return "cp1252" if kind == 1252 else "utf-8"

    def text_field(self, key: int) -> str:
        return self.exth.get(key, b"").decode("utf-8", "replace")

    @property
    def multibyte(self) -> bool:
        return bool(self.fields["extra_flags"] & 1)

    @property
    def trailers(self) -> int:
        return (self.fields["extra_flags"] >> 1).bit_count()


def read_headers(data: bytes) -> Mobi:
    """Metadata only; the first EXTH record of a type counts."""
    if len(data) < 0x4E + 16:
        raise MobiError("too short for a PDB header")
    name = data[:32].split(b"\0")[0].decode("latin-1")
    (count,) = struct.unpack_from(">H", data, 0x4C)
    if count < 2 or len(data) < 0x4E + 8 * count:
        raise MobiError("no records")
    offsets = [struct.unpack_from(">L", data, 0x4E + 8 * i)[0] for i in range(count)]
    at = offsets[0]
    if at + 16 + 132 > len(data):
        raise MobiError("too short for a MOBI header")
    compression, _, text_length, text_records, _size, encryption, _ = struct.unpack_from(">HHLHHHH", data, at)
    head = at + 16
    if data[head : head + 4] != b"MOBI":
        raise MobiError("no MOBI header")
    (length,) = struct.unpack_from(">L", data, head + 4)
    fields = {}
    for key, offset in FIELDS.items():
        kind = ">H" if key == "extra_flags" else ">L"
        fields[key] = struct.unpack_from(kind, data, head + offset)[0] if offset + struct.calcsize(kind) <= length and head + offset + 4 <= len(data) else 0
    title = data[at + fields["title_offset"] : at + fields["title_offset"] + fields["title_length"]].decode("utf-8", "replace")
    book = Mobi(data, offsets, compression, text_records, text_length, encryption, fields, title, {}, name)
    if fields["exth_flags"] & 0x40:
        start = head + length
        if data[start : start + 4] != b"EXTH":
            raise MobiError("no EXTH header")
        _, records = struct.unpack_from(">LL", data, start + 4)
        p = start + 12
        for _ in range(records):
            if p + 8 > len(data):
                raise MobiError("the EXTH header ends early")
            key, size = struct.unpack_from(">LL", data, p)
            book.exth.setdefault(key, data[p + 8 : p + size])
            p += max(size, 8)
    return book


def metadata(book: Mobi) -> dict:
    """The fields of a book row; an ISBN is read as decimal text, or as four bytes."""
    isbn = book.exth.get(EXTH["isbn"], b"")
    digits = isbn.decode("latin-1").replace("-", "").strip()
    number = int(digits) if digits.isascii() and digits.isdigit() and int(digits) < 2**64 else int.from_bytes(isbn, "big") if len(isbn) == 4 else 0
    subject = book.text_field(EXTH["subject"])
    return {
        "title": book.text_field(EXTH["title"]) or book.title,
        "author": book.text_field(EXTH["author"]),
        "contributor": book.text_field(EXTH["contributor"]),
        "publisher": book.text_field(EXTH["publisher"]),
        "description": book.text_field(EXTH["description"]),
        "language": book.text_field(EXTH["language"]),
        "rights": book.text_field(EXTH["rights"]),
        "isbn": number,
        "subject": [x.strip() for x in subject.split(",")] if subject else None,
        "pub_date": book.text_field(EXTH["pub_date"]),
    }


def text(book: Mobi) -> bytes:
    """The text records, decompressed and joined. Encrypted and later formats raise."""
    if book.encryption:
        raise MobiError("the text is encrypted")
    if book.fields["version"] > 6:
        raise MobiError(f"content of version {book.fields['version']} is not supported")
    dictionary = None
    if book.compression == 17480:
        first, n = book.fields["huff_record"], book.fields["huff_count"]
        dictionary = HuffCdic(book.record(first), [book.record(first + k) for k in range(1, n)])
    records = [trim_trailing(book.record(n), book.trailers, book.multibyte) for n in range(1, book.text_records + 1)]
    return b"".join(decompress_all(records, book.compression, dictionary))


def images(book: Mobi) -> list[bytes]:
    """Records from the first image to the last before the closing records."""
    first = book.fields["first_image"]
    if first in (0, NULL) or first >= len(book.offsets):
        return []
    out = []
    for n in range(first, len(book.offsets)):
        record = book.record(n)
        if record[:4] in (b"FLIS", b"FCIS", b"INDX", b"DATP", b"SRCS") or record == b"\xe9\x8e\r\n":
            break
        out.append(record)
    return out


def split_chapters(content: bytes, positions: list[int]) -> list[bytes]:
    """Slices from each distinct position to the next; the whole for none. What stands before the first opens it."""
    cuts = sorted({p for p in positions if 0 < p < len(content)})
    bounds = [0, *cuts, len(content)]
    return [content[a:b] for a, b in zip(bounds, bounds[1:]) if b > a] or [content]


# ------------------------------------------------------------------ writing


def _exth(book: dict) -> bytes:
    values = {k: book.get(k) for k in EXTH}
    values["isbn"] = str(book["isbn"]) if book.get("isbn") else None
    values["subject"] = ", ".join(book["subject"]) if book.get("subject") else None
    records = [(EXTH[k], str(v).encode()) for k, v in values.items() if v]
    body = b"".join(struct.pack(">LL", key, 8 + len(v)) + v for key, v in records)
    body += b"\0" * (-len(body) % 4)
    return b"EXTH" + struct.pack(">LL", 12 + len(body), len(records)) + body


def _index(entries: list[tuple[str, int, int]]) -> list[bytes]:
    """The table of contents as three records: meta index, entries (label, offset, length), labels."""
    labels, at, rows = bytearray(), [], []
    for label, *_ in entries:
        at.append(len(labels))
        raw = label.encode()
        labels += encode_vwi(len(raw)) + raw
    for k, (_, offset, length) in enumerate(entries):
        name = f"{k:03d}".encode()
        rows.append(bytes([len(name)]) + name + b"\x0f" + encode_vwi(offset) + encode_vwi(length) + encode_vwi(at[k]) + encode_vwi(0))
    tags = b"".join(bytes(x) for x in ((1, 1, 1, 0), (2, 1, 2, 0), (3, 1, 4, 0), (4, 1, 8, 0), (0, 0, 0, 1)))
    tagx = b"TAGX" + struct.pack(">LL", 12 + len(tags), 1) + tags

    def indx(kind: int, body: bytes, offsets: list[int], total: int, table: bytes = b"") -> bytes:
        place = 192 + len(table) + len(body)
        pad = -place % 4
        head = b"INDX" + struct.pack(">LLLLLLLLLLLL", 192, 0, kind, 2 if kind == 0 else 0, place + pad, len(offsets), 65001, NULL, total, 0, 0, 1 if kind == 0 else 0)
        idxt = b"IDXT" + b"".join(struct.pack(">H", x) for x in offsets)
        return head.ljust(180, b"\0") + struct.pack(">L", 192 if table else 0).ljust(12, b"\0") + table + body + b"\0" * pad + idxt + b"\0" * (-len(idxt) % 4)

    places, body = [], b""
    for row in rows:
        places.append(192 + len(body))
        body += row
    last = f"{max(len(entries) - 1, 0):03d}".encode()
    final = bytes([len(last)]) + last + struct.pack(">H", len(entries))
    return [indx(0, final, [192 + len(tagx)], len(entries), tagx), indx(1, body, places, len(entries)), bytes(labels) + b"\0" * (-len(labels) % 4)]


FLIS = b"FLIS" + struct.pack(">LHHLLHHLLL", 8, 65, 0, 0, NULL, 1, 3, 3, 1, NULL)
END = b"\xe9\x8e\r\n"


def write(book: dict, chapters: list[tuple[str, str]], pictures: list[bytes] = (), created: int = 0) -> bytes:
    """A MOBI 6 file of titled chapters of HTML, PalmDOC-compressed in records of 4096 bytes."""
    head, tail = b"<html><head></head><body>", b"</body></html>"
    parts = [(title, html.encode()) for title, html in chapters]
    entries, at = [], len(head)
    for title, raw in parts:
        entries.append((title, at, len(raw)))
        at += len(raw)
    content = head + b"".join(raw for _, raw in parts) + tail
    records = palmdoc_compress_all(content[i : i + 4096] for i in range(0, len(content), 4096))
    n_text = len(records)
    index = _index(entries)
    first_index = n_text + 1
    first_image = first_index + len(index)
    fcis = b"FCIS" + struct.pack(">LLLLLLLLLHHL", 20, 16, 1, 0, len(content), 0, 32, 8, 1, 1, 0, 0)
    rest = [*index, *pictures, FLIS, fcis, END]
    exth = _exth(book)
    title = str(book.get("title") or "").encode()
    header = bytearray(232)
    header[:4] = b"MOBI"
    put = lambda offset, value: struct.pack_into(">L", header, offset, value & NULL)
    for offset in range(24, 64, 4):
        put(offset, NULL)
    flis = first_image + len(pictures)
    for key, value in {
        "header_length": 232, "mobi_type": 2, "encoding": 65001, "unique_id": int(book.get("id") or 0), "version": 6, "first_non_text": first_index,
        "title_offset": 16 + 232 + len(exth), "title_length": len(title), "locale": 9, "min_version": 6,
        "first_image": first_image if pictures else NULL, "exth_flags": 0x50, "drm_offset": NULL,
    }.items():
        put(FIELDS[key], value)
    put(156, 0)
    struct.pack_into(">HH", header, 176, 1, flis - 1)
    put(184, flis + 1)
    put(188, 1)
    put(192, flis)
    put(196, 1)
    put(228, first_index)
    palmdoc = struct.pack(">HHLHHHH", 2, 0, len(content), n_text, 4096, 0, 0)
    record0 = palmdoc + bytes(header) + exth + title
    record0 += b"\0" * (2048 - len(record0) % 4 if len(record0) < 4 else -len(record0) % 4 + 2052)
    everything = [record0, *records, *rest]
    name = str(book.get("title") or "").replace(" ", "_")[:31].encode("ascii", "replace").ljust(32, b"\0")
    pdb = name + struct.pack(">HHLLLLLL", 0, 0, created, created, 0, 0, 0, 0) + b"BOOKMOBI" + struct.pack(">LLH", 2 * len(everything), 0, len(everything))
    at = len(pdb) + 8 * len(everything) + 2
    table = b""
    for k, record in enumerate(everything):
        table += struct.pack(">LL", at, 2 * k)
        at += len(record)
    return pdb + table + b"\0\0" + b"".join(everything)


def rewrite_metadata(data: bytes, book: dict) -> bytes:
    """The same file with other metadata. The headers must fit before the first text record."""
    old = read_headers(data)
    at, length = old.offsets[0], old.fields["header_length"]
    merged = {**metadata(old), **{k: v for k, v in book.items() if v is not None}}
    exth, title = _exth(merged), str(merged["title"]).encode()
    header = bytearray(data[at : at + 16 + length])
    for key, value in {"title_offset": 16 + length + len(exth), "title_length": len(title), "exth_flags": old.fields["exth_flags"] | 0x40}.items():
        struct.pack_into(">L", header, 16 + FIELDS[key], value)
    record = bytes(header) + exth + title
    room = old.offsets[1] - at
    if len(record) > room:
        raise MobiError(f"the new headers take {len(record)} bytes and there is room for {room}")
    name = str(merged["title"]).replace(" ", "_")[:31].encode("ascii", "replace").ljust(32, b"\0")
    return name + data[32:at] + record.ljust(room, b"\0") + data[old.offsets[1] :]
