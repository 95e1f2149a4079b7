"""The training-data queries by name, and the SQL that the ones SQL can express are held against."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .hmm import op2_hmm
from .mixing import OP5_SQL, op5_mixing
from .quality import op7_quality
from .ranked_search import OP13_SQL, op13_ranked_search
from .sharding import op11_sharding
from .simhash import op9_simhash
from .substring_dedup import op1_substring_dedup
from .tool_calls import op6_tool_calls
from .toxicity import op3_toxicity
from .url_filter import OP4_SQL, op4_url_filter
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_hmm": op2_hmm,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_tool_calls": op6_tool_calls,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL = {
    "op4_url_filter": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
