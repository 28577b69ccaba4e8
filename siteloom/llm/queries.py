"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteloom.llm.best_fit import op11_best_fit
from siteloom.llm.decontaminate import OP7_SQL, op7_decontaminate
from siteloom.llm.html import op5_html
from siteloom.llm.jaccard import OP9_SQL, op9_jaccard
from siteloom.llm.language import op2_language
from siteloom.llm.lm import OP1_SQL, op1_lm
from siteloom.llm.merkle import OP13_SQL, op13_merkle
from siteloom.llm.packing import op10_packing
from siteloom.llm.repair import OP12_SQL, op12_repair
from siteloom.llm.tokens import op3_tokens
from siteloom.llm.topk import OP4_SQL, op4_topk
from siteloom.llm.toxicity import op6_toxicity
from siteloom.llm.warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": op1_lm,
        "op2_language": op2_language,
        "op3_tokens": op3_tokens,
        "op4_topk": op4_topk,
        "op5_html": op5_html,
        "op6_toxicity": op6_toxicity,
        "op7_decontaminate": op7_decontaminate,
        "op8_warc": op8_warc,
        "op9_jaccard": op9_jaccard,
        "op10_packing": op10_packing,
        "op11_best_fit": op11_best_fit,
        "op12_repair": op12_repair,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_lm": OP1_SQL, "op4_topk": OP4_SQL, "op7_decontaminate": OP7_SQL, "op9_jaccard": OP9_SQL, "op12_repair": OP12_SQL, "op13_merkle": OP13_SQL}
