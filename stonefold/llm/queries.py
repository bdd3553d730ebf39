"""The queries of this package and the SQL they are held against."""

from __future__ import annotations

from stonefold.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from stonefold.llm.kneser_ney import op4_quality_classifier
from stonefold.llm.license_scan import OP2_SQL, op2_license_scan
from stonefold.llm.packing import op3_packing
from stonefold.llm.quality_rules import OP5_SQL, op5_quality_rules
from stonefold.llm.sentencepiece_codec import op1_sentencepiece
from stonefold.llm.simhash import op10_simhash
from stonefold.llm.toxicity import op7_toxicity
from stonefold.llm.url_filter import OP9_SQL, op9_url_filter
from stonefold.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
}

#: DuckDB SQL by query; a query that SQL cannot express has a brute-force test instead.
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_url_filter": OP9_SQL,
}
