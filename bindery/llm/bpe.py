"""Operator 10: byte-level BPE by recursive queries in DuckDB, within each partition.

Words (the matches of the pre-tokenization pattern) become rows (word, position, token), at first a
token a byte. Each turn of a recursive query joins adjacent tokens to the merge table, takes each
word's pair of least rank, the leftmost of equals, and contracts it; words without such a pair are
done. Decoding joins token ids to their bytes and aggregates them in order of position.

Each distinct word is encoded once per worker and cache period. In words of over ``LONG`` bytes a turn contracts
all places of the word's pair of least rank that one-by-one contraction would take next, so a very long word
takes few turns too.

Nulls: a null text counts as empty and has no ids; a null doc_id is kept. Equal rows each give a row.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import few, held, lean, table
from bindery.llm.tokens import PieceTable, ragged
from bindery.llm.words import text_blocks

#: Words kept per worker before the store starts anew.
CACHE_WORDS = 800_000
#: Bytes of text encoded at a time; words of a block of queries; bytes from which a word's turns contract more than one pair.
BLOCK, WORDS, LONG = 4_000_000, 50_000, 64

#: A state has each token's position, the position before it, and the word's best pair as id * 2 ** 40 + position.
#: Ids are ranks, so the least number is the pair of least rank and leftmost of equals.
ENCODE = """
WITH RECURSIVE s AS (
  SELECT word, pos, tok, before, min((mid << 40) | pos) OVER (PARTITION BY word) AS best
  FROM (SELECT word, pos, tok, lag(pos) OVER w AS before, (tok << 20) | lead(tok) OVER w AS key FROM bytes WINDOW w AS (PARTITION BY word ORDER BY pos))
  LEFT JOIN merges USING (key)
  UNION ALL
  SELECT word, pos, tok, before, min((mid << 40) | pos) OVER (PARTITION BY word) AS best
  FROM (SELECT word, pos, tok, lag(pos) OVER w AS before, (tok << 20) | lead(tok) OVER w AS key
        FROM (SELECT word, pos, CASE WHEN pos = (best & ((1::BIGINT << 40) - 1)) THEN best >> 40 ELSE tok END AS tok
              FROM s WHERE best IS NOT NULL AND before IS DISTINCT FROM (best & ((1::BIGINT << 40) - 1)))
        WINDOW w AS (PARTITION BY word ORDER BY pos))
  LEFT JOIN merges USING (key)
)
SELECT word, pos, tok FROM s WHERE best IS NULL
"""
#: The same for long words, whose turns contract all places of the pair of least rank, from the left, up to the first
#: whose contraction makes a pair of a lesser rank: up to there, these are the next contractions one by one.
ENCODE_LONG = """
WITH RECURSIVE s AS (
  SELECT word, i, tok, mid, min(mid) OVER (PARTITION BY word) AS best
  FROM (SELECT word, pos AS i, tok, (tok << 20) | lead(tok) OVER w AS key FROM bytes WINDOW w AS (PARTITION BY word ORDER BY pos))
  LEFT JOIN merges USING (key)
  UNION ALL
  SELECT word, i, tok, mid, min(mid) OVER (PARTITION BY word) AS best
  FROM (
    SELECT word, row_number() OVER w - 1 AS i, tok, (tok << 20) | lead(tok) OVER w AS key
    FROM (
      SELECT word, i, CASE WHEN done THEN best ELSE tok END AS tok, coalesce(lag(done) OVER (PARTITION BY word ORDER BY i), false) AS gone
      FROM (
        SELECT word, i, tok, best, taken AND i <= coalesce(min(CASE WHEN taken AND (l.mid < best OR r.mid < best) THEN i END) OVER (PARTITION BY word), i) AS done
        FROM (
          SELECT word, i, tok, best, taken, ((CASE WHEN lag(taken, 2) OVER w THEN best ELSE lag(tok) OVER w END) << 20) | best AS left_key, (best << 20) | lead(tok, 2) OVER w AS right_key
          FROM (SELECT *, mid IS NOT DISTINCT FROM best AND (i - coalesce(max(CASE WHEN mid IS DISTINCT FROM best THEN i END) OVER (PARTITION BY word ORDER BY i ROWS UNBOUNDED PRECEDING), -1)) % 2 = 1 AS taken FROM s WHERE best IS NOT NULL)
          WINDOW w AS (PARTITION BY word ORDER BY i))
        LEFT JOIN merges l ON l.key = left_key LEFT JOIN merges r ON r.key = right_key))
    WHERE NOT gone WINDOW w AS (PARTITION BY word ORDER BY i))
  LEFT JOIN merges USING (key)
)
SELECT word, i AS pos, tok FROM s WHERE best IS NULL
"""
#: Bytes stand as characters from 256 on, since only strings are aggregated.
DECODE = "SELECT text, string_agg(s, '' ORDER BY pos) AS s FROM ids JOIN vocabulary USING (id) GROUP BY text"


class DuckBpe:
    """Encoder and decoder over one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        pairs = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        key, mid = (pa.array(x, pa.int64()) for x in zip(*pairs))
        self._table("merges", pa.table({"key": key, "mid": mid}))
        self._table("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int64()), "s": ["".join(chr(256 + b) for b in t) for t in ranks]}))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        self.words: dict[str, int] = {}
        self.flat, self.sizes, self.starts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pieces = PieceTable(self._pieces)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _run(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.con.register(name, rows)
        out = self.con.sql(query).to_arrow_table()
        self.con.unregister(name)
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")  # words of like length end in like turns
        brief = int(np.searchsorted(sizes[order], LONG, "right"))
        for query, own in [(ENCODE, order[k : min(k + WORDS, brief)]) for k in range(0, brief, WORDS)] + [(ENCODE_LONG, order[brief:])] * (brief < len(order)):
            n = sizes[own]
            own = own.tolist()
            flat = np.frombuffer(b"".join(words[i] for i in own), np.uint8)
            word = np.repeat(np.arange(len(own), dtype=np.int32), n)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            found = self._run(query, "bytes", pa.table({"word": word, "pos": pos, "tok": self.byte_ids[flat]}))
            at = found.column("word").to_numpy()
            by_place = np.lexsort((found.column("pos").to_numpy(), at))
            counts = np.bincount(at, minlength=len(own))
            for i, ids in zip(own, np.split(found.column("tok").to_numpy()[by_place].astype(np.uint32), np.cumsum(counts)[:-1])):
                out[i] = ids
        return out

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.flat, self.sizes = {}, np.empty(0, np.uint32), np.empty(0, np.int64)
        split = [self.pattern.findall(x) for x in pieces]
        words = self.words
        new = list(dict.fromkeys(w for own in split for w in own if w not in words))
        if new:
            found = self.merge([w.encode() for w in new])
            words.update(zip(new, range(len(words), len(words) + len(new))))
            self.flat = np.concatenate([self.flat, *found])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found))])
            self.starts = np.cumsum(self.sizes) - self.sizes
        codes = np.fromiter((words[w] for own in split for w in own), np.int64)
        sizes = self.sizes[codes]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]
        return self.flat[ragged(self.starts[codes], sizes)], np.diff(bounds)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) of the texts data[offsets[i]:offsets[i + 1]]."""
        return self.pieces.encode(data, offsets)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pos = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        found = self._run(DECODE, "ids", pa.table({"text": text, "pos": pos, "id": ids.astype(np.int64)}))
        out = [b""] * len(sizes)
        for i, s in zip(found.column("text").to_pylist(), found.column("s").to_pylist()):
            out[i] = (np.frombuffer(s.encode("utf-16-le"), np.uint16) - 256).astype(np.uint8).tobytes()
        return out


def duck_bpe(path: str, pattern: str) -> DuckBpe:
    return held(("bpe", path, pattern), lambda: DuckBpe(path, pattern))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row of ``docs`` (doc_id, text)."""

    @lean
    def run(batches):
        bpe = duck_bpe(ranks, pattern)
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column("text"), BLOCK):
                flat, sizes = bpe.encode(data, offsets)
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode(flat, sizes)]
                packed = [x.tobytes() for x in np.split(flat.astype("<u4"), np.cumsum(sizes)[:-1])]
                out = [batch.column("doc_id").slice(i, j - i), pa.array(sizes), pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array(decoded)]
                yield pa.record_batch(out + [pa.array(packed)] * keep_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op10_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return few(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
