import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from bindery.llm import ann, bpe, host_quality, language, license_scan, line_dedup, near_dups, packing, repeats, token_files
from bindery.llm.common import Scratch
from bindery.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
BYTE, WORD, RANKS = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
FIELDS = "doc_id long, text string, lang string, source string, kept string, d int, t int, score string, rest string"


def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    passage = prose(60)
    base = prose(150).split(" ")
    out = [prose(rng.randint(1, 120)) for _ in range(30)]
    out += [prose(20) + " " + passage + " " + prose(10) for _ in range(6)]
    for _ in range(25):  # loose and close copies of one text
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 6])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    out += [out[3]] * 12 + ["x y"] * 3 + [prose(5000), passage + " " + passage]
    out += ["a\nb\nc\nd\n" + prose(5), "z\na\nb\nc\nd", "a\nb\nc\na\nb\nc", "\n\n\n\n\n", "l1\r\nl2\r\nl3"]
    out += [None, "", " ", "\t\n \x0b", "word", "Released under the MIT License.", "Apache License mit license, GNU General  Public\nLICENSE", "K license é\xa0日本語 🎉 <|endoftext|> 123", "!!! ### $$$", "é " * 30]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, x, ["en", "de", "fr", None][i % 4], ["hot", "hot", "cold", None][i % 4]) for i, x in enumerate(texts())]
    random.Random(1).shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "s", "r") for r in rows], FIELDS).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """With null ids and repeated rows."""
    return spark.createDataFrame([(*r, "k", 1, 2, "s", "r") for r in [*rows[:40], *rows[:5], (None, "a b c d e f", None, None), (None, None, None, None)]], FIELDS)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


# ------------------------------------------------------------------ token files, packing, BPE


def encoded(path, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return {i: np.array(tokenizer.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x, *_ in rows}


def test_token_files(spark, docs, rows):
    data = token_files.write_tokens(docs, Scratch(spark, "t").path("files"), BYTE, length=64)
    wanted, start = encoded(BYTE, rows), 0
    got = by_id(token_files.read_documents(spark, data), "start", "n_tokens", "ids_crc32")
    for i in sorted(wanted):
        assert got[i] == (start, len(wanted[i]), zlib.crc32(wanted[i].tobytes()))
        start += len(wanted[i])
    flat, joined = np.concatenate([wanted[i] for i in sorted(wanted)]), []
    for f, (_, n, _) in enumerate(data.files):
        for k in range(-(-n // 64)):
            tokens, mask = token_files.read_sequence(data, f, k)
            assert len(tokens) == len(mask) == 64 and tokens.dtype == np.uint16
            joined.append(tokens[mask])
    assert (np.concatenate(joined) == flat).all()


def test_packing(docs, rows):
    wanted = encoded(WORD, rows)
    for capacity in (packing.Capacity(128), packing.Capacity(128, rule="dot"), packing.Capacity(128, documents=3, attention=9000, weights=(1.0, 0.2, 0.2))):
        if capacity.attention:
            plan = packing.plan_bins({60: 5, 20: 40, 7: 100}, capacity)
            assert sum(1 for _ in plan)
            continue
        bins = defaultdict(list)
        seen = defaultdict(list)
        for r in packing.pack_documents(docs, WORD, capacity, keep_ids=True).collect():
            bins[r.sequence_id].append((r.offset, r.length))
            seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32, np.frombuffer(r.ids, "<u4")))
        for b in bins.values():
            end = 0
            for offset, length in sorted(b):
                assert offset == end
                end += length
            assert end <= 128
        for i, ids in wanted.items():
            parts = sorted(seen[i], key=lambda p: p[0])
            assert (np.concatenate([p[4] for p in parts]) == ids).all() and len(parts) == -(-len(ids) // 128)
            assert all(p[3] == zlib.crc32(p[4].tobytes()) for p in parts)
        total = sum(map(len, wanted.values()))
        assert len(bins) <= -(-total // 128) + 3


def test_packing_keeps_every_limit():
    rng = np.random.default_rng(0)
    for rule in ("norm", "dot"):
        counts = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 129), 60, replace=False), rng.integers(1, 400, 60))}
        capacity = packing.Capacity(128, documents=5, attention=8000 if max(counts) < 89 else 128 * 128, weights=(1.0, 0.1, 0.1), rule=rule)
        moves = packing.plan_bins(counts, capacity)
        used = defaultdict(lambda: [0, 0, 0])
        by_size = defaultdict(list)
        for m in moves:
            by_size[m[0]].append(m)
        for size, own in by_size.items():
            own.sort(key=lambda m: m[1])
            assert own[0][1] == 0
            for m, after in zip(own, [x[1] for x in own[1:]] + [counts[size]]):
                for k in range(after - m[1]):
                    b = used[m[2] + k]
                    b[0], b[1], b[2] = b[0] + size, b[1] + 1, b[2] + size * size
        assert (np.array(list(used.values())) <= capacity.limits()).all()
        assert sum(b[1] for b in used.values()) == sum(counts.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(None, None), (6, None), (9, 5000)])
def test_packing_matches_a_plain_loop(rule, documents, attention):
    """As many sequences as placing the items one by one in the open bin that scores best."""
    rng = np.random.default_rng(5)
    for _ in range(6):
        items = sorted(rng.integers(1, 65, 300).tolist(), reverse=True)
        capacity = packing.Capacity(64, documents, attention, (1.0, 0.3, 0.2), rule)
        limits = capacity.limits()
        weights = np.array(capacity.weights) / limits.astype(float) ** 2
        bins = []
        for size in items:
            demand = np.array([size, 1, size * size])
            scored = [((weights * (b - demand) ** 2).sum() if rule == "norm" else -(weights * demand * b).sum(), k) for k, b in enumerate(bins) if (b >= demand).all()]
            if scored:
                bins[min(scored)[1]] -= demand
            else:
                bins.append(limits - demand)
        moves = packing.plan_bins(dict(Counter(items)), capacity)
        tops = defaultdict(list)
        for size, rank, first, _ in moves:
            tops[size].append((rank, first))
        n = 0
        for size, own in tops.items():
            own.sort()
            n = max(n, *(first + after - rank for (rank, first), after in zip(own, [r for r, _ in own[1:]] + [items.count(size)])))
        assert abs(n - len(bins)) <= (0 if documents is None and attention is None else 1)


def test_bpe(docs, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encode_decode(docs, RANKS, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text, *_ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    own = bpe.duck_bpe(RANKS, P.PATTERN)
    for text in ("ab" * 3000, "=" * 999, "zzzzzyx" * 40):
        data = np.frombuffer(text.encode(), np.uint8)
        flat, sizes = own.encode(data, np.array([0, len(data)]))
        assert flat.tolist() == library.encode_ordinary(text) and own.decode(flat, sizes) == [text.encode()]


# ------------------------------------------------------------------ licenses, language, neighbours


def test_licenses(docs, rows):
    got = by_id(license_scan.scan_licenses(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    import re

    lower = {65 + i: 97 + i for i in range(26)}
    for i, text, *_ in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        places = [(k, label) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert got[i][:5] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_license_templates(spark):
    text = license_scan.TEMPLATES["mit"][0].split()
    whole, cut, gone = " ".join(["so"] * 9 + text), " ".join(["so"] * 3 + text[:6] + ["and", "more"] + text[7:]), " ".join(text[:5])
    df = spark.createDataFrame([(1, whole), (2, cut), (3, gone), (4, "bsd license bsd license"), (5, None)], "doc_id long, text string")
    got = by_id(license_scan.scan_licenses(df), "labels", "score", "n_base")
    assert got[1] == ("mit", 1.0, 0) and got[2][0] == "mit" and 0.75 <= got[2][1] < 1 and got[3] == ("", 0.0, 0) and got[4][0] == "bsd" and got[5] == ("", 0.0, 0)


def test_language(spark, docs, rows):
    frame = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in frame]) > 0.97
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = by_id(language.identify(docs.select("doc_id", "text"), model, ["doc_id"]), "lang_pred", "score")
    for i, text, *_ in rows:
        assert (got[i][0] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= got[i][1] <= 1
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs.select("doc_id", "text"), None, ["doc_id"]).collect()} == {"und"}
    single = language.fit(docs.where("lang = 'en'"))
    assert single.predict(language.features(np.frombuffer(b"hello you", np.uint8), np.array([0, 9])))[0] == ["en"]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(300)]  # a third as copies would crowd a graph
    vectors += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] + [1.0] * 15), (5004, [float("nan")] * 16), (5005, [float("inf")] * 16), (None, [1.0] * 16), (5020, [1.0] * 8)]
    df = ann.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    assert df.count() == 1801
    got = defaultdict(list)
    for r in ann.nearest(df.where("id % 20 = 0"), df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, v in vectors[:1800]])
    x = np.array([v for _, v in vectors[:1800]], np.float32).astype(np.float64)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and q not in [v for _, v, _ in got[q]]
        hit, total = hit + len(set(best) & {v for _, v, _ in got[q]}), total + 20
    assert hit / total >= 0.9
    assert 5020 not in got


# ------------------------------------------------------------------ duplicates


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, words, percent, monkeypatch):
    monkeypatch.setattr(near_dups, "PIVOTS", 1)
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    sets = {i: shingles(x, words) for i, x, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                links += 1
    got = by_id(near_dups.near_duplicates(docs, near_dups.Near(words, percent)), "n_shingles", "component_id", "kept")
    assert links > 60
    for i in sets:
        assert got[i] == (len(sets[i]), find(i), find(i) == i)


def test_repeats(docs, rows):
    seen, n = set(), 0
    got = by_id(repeats.remove_repeats(docs, 20, keep_text=True, carry=("kept", "d", "t")), "n_words", "n_removed", "kept_sha256", "text", "kept", "d", "t")
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone |= set(range(k, k + 20))
            seen.add(window)
        kept = [w for k, w in enumerate(words) if k not in gone]
        assert got[i][:3] == (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
        assert (got[i][3] or "").encode().split() == kept and got[i][4:] == ("k", 1, 2)
        n += len(gone)
    assert n > 1000


def test_lines_and_rules_match_sql(spark, docs, rows):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    lines = line_dedup.line_dedup(docs.select("doc_id", "text"))
    lines = lines.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
    for name, got in (("op6_line_dedup", lines), ("op7_host_quality", host_quality.host_quality(docs))):
        wanted = con.sql(ORACLE_SQL[name]).fetchall()
        names = [d[0] for d in con.sql(ORACLE_SQL[name]).description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(wanted)


def test_host_prior(spark):
    rows = [(i, "good", "w " * 60 + str(i)) for i in range(60)] + [(100 + i, "bad", "# " * 80) for i in range(60)] + [(200, "new", "x")]
    rows = [(i, h, " ".join(f"w{k}{i}" for k in range(60)) if h == "good" else x) for i, h, x in rows]
    rows += [(300 + i, "bad", " ".join(f"w{k}{i}" for k in range(60))) for i in range(3)]
    got = by_id(host_quality.host_quality(spark.createDataFrame(rows, "doc_id long, source string, text string")), "base_failed", "kept")
    assert all(got[i] == (False, True) for i in range(60)) and got[100] == (True, False) and got[300] == (False, False)


# ------------------------------------------------------------------ odd rows


OPERATORS = {
    "tokens": lambda df: token_files.read_documents(df.sparkSession, token_files.write_tokens(df, Scratch(df.sparkSession, "t").path("f"), BYTE)),
    "licenses": license_scan.scan_licenses,
    "language": lambda df: language.identify(df.select("doc_id", "text"), language.fit(df), ["doc_id"]),
    "packing": lambda df: packing.pack_documents(df, WORD).where("piece = 0"),
    "lines": lambda df: line_dedup.line_dedup(df.select("doc_id", "text")),
    "quality": host_quality.host_quality,
    "near": near_dups.near_duplicates,
    "repeats": repeats.remove_repeats,
    "bpe": lambda df: bpe.encode_decode(df, RANKS, P.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(odd, name):
    got = Counter(r.doc_id for r in OPERATORS[name](odd).collect())
    assert got == Counter(r.doc_id for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_empty_vectors(spark):
    df = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.nearest(df, df).count() == 0


def test_queries_over_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in QUERIES.items():
        if name.startswith(("op2_", "op6_", "op7_")):
            assert query(spark, SF).count() == n


# ------------------------------------------------------------------ repeats, ties, very long texts


def test_numerals_are_no_letters(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, "½ ² 12"), (2, "①② Ⅷ"), (3, "12 a"), (4, None)]
    got = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]), "lang_pred", "score")
    assert [got[i][0] == "und" for i in (1, 2, 3, 4)] == [True, True, False, True]


def test_fit_is_bounded_with_repeated_ids(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").select("doc_id", "text", "lang")
    same = docs.limit(1).crossJoin(spark.range(300)).drop("id")
    sizes = []
    monkeypatch.setattr(language, "fit_svm", lambda rows, y, f=language.fit_svm: (sizes.append(len(rows)), f(rows, y))[1])
    langs = docs.select("lang").distinct().count()
    a = language.fit(docs.unionByName(same), 10)
    assert max(sizes) <= 10 * langs
    b = language.fit(docs, 10)
    assert (a.family_weights == b.family_weights).all()


def test_language_columns_of_clashing_names(odd):
    out = language.identify(odd.selectExpr("doc_id", "text", "kept AS score", "d AS lang_pred", "t AS other"), None, ["doc_id", "score", "lang_pred", "other"])
    assert out.columns == ["doc_id", "other", "lang_pred", "score"] and {r.score for r in out.collect()} == {0.0}
    lines = line_dedup.line_dedup(odd.withColumn("n_lines", F.lit("x")))
    assert lines.columns.count("kept") == 1 and lines.columns.count("n_lines") == 1 and lines.count() == odd.count()


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(80, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(0, base[0].tolist())] * 30 + [(1000 + i, base[0].tolist()) for i in range(30)] + [(20, base[20].tolist())]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")))
    got = defaultdict(list)
    for r in ann.nearest(df.where("id % 20 = 0"), df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    own = sorted({(i, tuple(v)) for i, v in rows})
    for q in (0, 20, 40, 60):
        scores = sorted(((-(np.array(v) @ base[q]), i) for i, v in own if i != q))[:20]
        assert [v for v, _ in got[q]] == [i for _, i in scores] and len(got[q]) == 20
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in scores], rtol=1e-12, atol=0)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rng = random.Random(11)
    a, b = ([f"w{rng.randint(0, 10**6)}" for _ in range(120)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[1:])), (4, "other words stand here alone"), (4, "other words stand here alone")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dups.Near(3, 85)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_common_pairs_vote_too(spark):
    words = next(p for p in license_scan.TEMPLATES["gpl"] if "under the terms" in p).split()
    k = words.index("under")
    text = " ".join([*words[:k], "x", "under", "the", "y", *words[k + 2 :]])
    got = by_id(license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")), "score", "labels")
    assert got[1][0] == 1.0 and "gpl" in got[1][1]


def long_text(n):
    rng = random.Random(n)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}" for k in range(3000)] + ["of", "the", "under", "license", "mit"]
    return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(n // 20))


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_text(spark, name):
    """One text of 60,000 words among brief ones."""
    rows = [(1, long_text(60_000), "en", "s"), (2, "brief", "en", "s"), (3, "=" * 20_000, "en", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in OPERATORS[name](df).collect()} == {1, 2, 3}
