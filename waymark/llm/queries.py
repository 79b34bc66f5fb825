"""The registered queries of this package and the SQL that states the same results."""

from __future__ import annotations

from waymark.llm.ann import op5_ann
from waymark.llm.decontaminate import op2_decontaminate
from waymark.llm.language_id import op3_language_id
from waymark.llm.near_dup import op4_near_dup
from waymark.llm.packing import op9_packing
from waymark.llm.quality import op6_quality
from waymark.llm.secrets import SQL as SECRETS_SQL
from waymark.llm.secrets import op7_secrets
from waymark.llm.toxicity import op1_toxicity
from waymark.llm.url_filter import SQL as URL_FILTER_SQL
from waymark.llm.url_filter import op8_url_filter
from waymark.llm.warc import SQL as WARC_SQL
from waymark.llm.warc import op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_near_dup": op4_near_dup,
    "op5_ann": op5_ann,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
}

SQL: dict[str, str] = {
    "op7_secrets": SECRETS_SQL,
    "op8_url_filter": URL_FILTER_SQL,
    "op10_warc": WARC_SQL,
}
