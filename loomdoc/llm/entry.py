"""The queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from loomdoc.llm import chat, decontam, langid, licenses, mixing, neardup, quality, topk, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_licenses": licenses.op2_licenses,
    "op3_decontam": decontam.op3_decontam,
    "op4_neardup": neardup.op4_neardup,
    "op5_quality": quality.op5_quality,
    "op6_topk": topk.op6_topk,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_langid": langid.op9_langid,
    "op10_chat": chat.op10_chat,
}
ORACLES: dict[str, str] = {
    "op2_licenses": licenses.ORACLE,
    "op3_decontam": decontam.ORACLE,
    "op6_topk": topk.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_chat": chat.ORACLE,
}
