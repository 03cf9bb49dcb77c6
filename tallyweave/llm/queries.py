"""The registered queries of this subpackage and the SQL that DuckDB can run for them."""

from __future__ import annotations

from .decontamination import OP7_SQL, op7
from .html import op6
from .licenses import op8
from .merkle import OP13_SQL, op13
from .negatives import OP12_SQL, op12
from .neighbours import op11
from .packing import op2
from .search import op10
from .secrets import op3
from .simhash import op4
from .substring import OP5_SQL, op5
from .toxicity import op1
from .warc import OP9_SQL, op9

QUERIES = {
    "op1_toxicity": op1,
    "op2_harmonic_packing": op2,
    "op3_secret_scan": op3,
    "op4_simhash_near_dedup": op4,
    "op5_substring_dedup": op5,
    "op6_html_extraction": op6,
    "op7_benchmark_decontamination": op7,
    "op8_license_scan": op8,
    "op9_warc": op9,
    "op10_top_k_search": op10,
    "op11_learned_partitions": op11,
    "op12_hard_negatives": op12,
    "op13_merkle_manifest": op13,
}

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": OP5_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
