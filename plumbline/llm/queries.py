"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import op8_licenses as licenses
from plumbline.llm.op1_tokens import op1_tokens
from plumbline.llm.op2_mixing import op2_mixing
from plumbline.llm.op3_packing import op3_packing
from plumbline.llm.op4_decontamination import op4_decontamination
from plumbline.llm.op5_media import op5_media
from plumbline.llm.op6_language import op6_language
from plumbline.llm.op7_toxicity import op7_toxicity
from plumbline.llm.op9_warc import op9_warc
from plumbline.llm.op10_simhash import op10_simhash

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_media": op5_media,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": licenses.op8_licenses,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op8_licenses": licenses.ORACLE}
