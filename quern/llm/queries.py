"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.chat import op9_chat_format
from quern.llm.decontaminate import op6_decontamination
from quern.llm.divergence import OP11_SQL, op11_source_divergence
from quern.llm.forest import op12_embedding_near_dedup
from quern.llm.licenses import op5_license_scan
from quern.llm.neighbours import op7_nearest_neighbours
from quern.llm.ngram import op10_lm_score
from quern.llm.packing import op8_packing
from quern.llm.quality import op4_quality
from quern.llm.resample import op13_importance_resampling
from quern.llm.simhash import op2_simhash
from quern.llm.toxicity import op1_toxicity
from quern.llm.url_filter import OP3_SQL, op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn for fn in (
        op1_toxicity, op2_simhash, op3_url_filter, op4_quality, op5_license_scan,
        op6_decontamination, op7_nearest_neighbours, op8_packing, op9_chat_format, op10_lm_score,
        op11_source_divergence, op12_embedding_near_dedup, op13_importance_resampling,
    )
}

ORACLES: dict[str, str] = {"op3_url_filter": OP3_SQL, "op11_source_divergence": OP11_SQL}
