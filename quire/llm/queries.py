"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op2_ann
from .embed_dedup import op5_embedding_dedup
from .fim import OP11_SQL, op11_fill_in_middle
from .langid import op3_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .packing import op6_packing
from .quality import op4_quality
from .sharding import OP12_SQL, op12_sharding
from .simhash import op9_simhash
from .tokenfile import op10_token_files
from .warc import OP8_SQL, op8_warc
from .whitening import op13_whitening

QUERIES = {
    "op2_ann": op2_ann,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op10_token_files": op10_token_files,
    "op6_packing": op6_packing,
    "op8_warc": op8_warc,
    "op4_quality": op4_quality,
    "op3_language_id": op3_language_id,
    "op1_line_dedup": op1_line_dedup,
    "op9_simhash": op9_simhash,
    "op7_mixing": op7_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_sharding": op12_sharding,
    "op13_whitening": op13_whitening,
}
ORACLE = {
    "op8_warc": OP8_SQL,
    "op1_line_dedup": OP1_SQL,
    "op7_mixing": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_sharding": OP12_SQL,
}
