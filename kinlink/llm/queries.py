"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, language, lm, mixing, neardup, passages, privacy, quality, secrets, warc


def queries() -> dict:
    return {"op1_mixing": mixing.op1_mixing, "op2_neardup": neardup.op2_neardup, "op3_language": language.op3_language, "op4_decontam": decontam.op4_decontam, "op5_quality": quality.op5_quality, "op6_privacy": privacy.op6_privacy, "op7_lm": lm.op7_lm, "op8_passages": passages.op8_passages, "op9_warc": warc.op9_warc, "op10_secrets": secrets.op10_secrets}


def oracle_sql() -> dict:
    return {"op1_mixing": mixing.OP1_SQL, "op2_neardup": neardup.OP2_SQL, "op8_passages": passages.OP8_SQL, "op9_warc": warc.OP9_SQL}
