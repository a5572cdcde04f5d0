"""The queries of this package, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import functools

from bindery.deploy import ship
from bindery.llm.ann import op4_nearest_neighbours
from bindery.llm.bpe import op10_duckdb_bpe
from bindery.llm.host_quality import OP7_SQL, op7_host_quality
from bindery.llm.language import op3_language_id
from bindery.llm.license_scan import OP2_SQL, op2_license_scan
from bindery.llm.line_dedup import OP6_SQL, op6_line_dedup
from bindery.llm.near_dups import OP8_SQL, op8_minhash_near_dedup
from bindery.llm.packing import op5_best_fit_packing
from bindery.llm.repeats import OP9_SQL, op9_repeated_passages
from bindery.llm.token_files import op1_token_files


def _query(f):
    @functools.wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _query(f)
    for f in (
        op1_token_files,
        op2_license_scan,
        op3_language_id,
        op4_nearest_neighbours,
        op5_best_fit_packing,
        op6_line_dedup,
        op7_host_quality,
        op8_minhash_near_dedup,
        op9_repeated_passages,
        op10_duckdb_bpe,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": OP2_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_host_quality": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op9_repeated_passages": OP9_SQL,
}
