"""Queries of the thirteen operators and the pipeline, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_substring_dedup as op1
from . import op7_warc as op7
from . import op10_neighbours as op10
from . import op12_fill_in_middle as op12
from .op2_packing import op2_packing
from .op3_token_counts import op3_token_counts
from .op4_fingerprints import op4_fingerprints
from .op5_ngram_join import op5_ngram_join
from .op6_mixing import op6_mixing
from .op8_license_scans import op8_license_scans
from .op9_toxicity import op9_toxicity
from .op11_periodic_runs import op11_periodic_runs
from .op13_quality import op13_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1.op1_substring_dedup,
        "op2_packing": op2_packing,
        "op3_token_counts": op3_token_counts,
        "op4_fingerprints": op4_fingerprints,
        "op5_ngram_join": op5_ngram_join,
        "op6_mixing": op6_mixing,
        "op7_warc": op7.op7_warc,
        "op8_license_scans": op8_license_scans,
        "op9_toxicity": op9_toxicity,
        "op10_neighbours": op10.op10_neighbours,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_fill_in_middle": op12.op12_fill_in_middle,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": op1.ORACLE_SQL, "op7_warc": op7.ORACLE_SQL, "op10_neighbours": op10.ORACLE_SQL, "op12_fill_in_middle": op12.ORACLE_SQL}
