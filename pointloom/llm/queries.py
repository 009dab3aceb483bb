"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, mixing
from .chat import op6_chat
from .html_text import op2_html_text
from .knn_quality import op4_knn_quality
from .langid import op8_langid
from .line_crf import op1_line_crf
from .mixing import op9_mixing
from .multi_index import op10_multi_index
from .packing import op3_packing
from .simhash import op7_simhash
from .suffix_dedup import op5_suffix_dedup


def queries():
    return {
        "op1_line_crf": op1_line_crf,
        "op2_html_text": op2_html_text,
        "op3_packing": op3_packing,
        "op4_knn_quality": op4_knn_quality,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_chat": op6_chat,
        "op7_simhash": op7_simhash,
        "op8_langid": op8_langid,
        "op9_mixing": op9_mixing,
        "op10_multi_index": op10_multi_index,
    }


def oracle_sql():
    return {"op6_chat": chat.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
