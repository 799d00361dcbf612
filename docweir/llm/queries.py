"""The training-data queries by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .chat_format import ORACLE as CHATS_SQL
from .chat_format import op8_chats
from .collocations import ORACLE as COLLOCATIONS_SQL
from .collocations import op13_collocations
from .decontaminate import ORACLE as DECONTAMINATE_SQL
from .decontaminate import op1_decontaminate
from .neighbours import op7_neighbours
from .pieces import op6_sentencepiece
from .quality import op5_quality
from .sanitise import op9_pii
from .sharding import op10_shards
from .simhash import op2_simhash
from .substrings import ORACLE as SUBSTRINGS_SQL
from .substrings import op11_substrings
from .toxicity import op3_toxicity
from .url_filter import op4_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_neighbours": op7_neighbours,
    "op8_chats": op8_chats,
    "op9_pii": op9_pii,
    "op10_shards": op10_shards,
    "op11_substrings": op11_substrings,
    "op12_alignment": op12_alignment,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": DECONTAMINATE_SQL, "op8_chats": CHATS_SQL, "op11_substrings": SUBSTRINGS_SQL, "op13_collocations": COLLOCATIONS_SQL}
