"""One query for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orospark.llm.decontaminate import OP9_SQL, op9_decontaminate
from orospark.llm.hamming import OP2_SQL, op2_hamming_top_k
from orospark.llm.packing import op8_packing
from orospark.llm.pii import op1_pii
from orospark.llm.quality import op7_quality
from orospark.llm.secrets import op6_secrets
from orospark.llm.sharding import op4_sharding
from orospark.llm.simhash import op10_simhash
from orospark.llm.token_files import op5_token_files
from orospark.llm.toxicity import op3_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_hamming_top_k": op2_hamming_top_k,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_token_files": op5_token_files,
        "op6_secrets": op6_secrets,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_decontaminate": op9_decontaminate,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_hamming_top_k": OP2_SQL, "op9_decontaminate": OP9_SQL}
