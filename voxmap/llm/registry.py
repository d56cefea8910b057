"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from voxmap.llm import op5_cosine as _op5
from voxmap.llm import op7_minhash as _op7
from voxmap.llm.op1_resharding import op1_resharding
from voxmap.llm.op2_decontaminate import op2_decontaminate
from voxmap.llm.op3_lines import op3_lines
from voxmap.llm.op4_html import op4_html
from voxmap.llm.op5_cosine import op5_cosine
from voxmap.llm.op6_packing import op6_packing
from voxmap.llm.op7_minhash import op7_minhash
from voxmap.llm.op8_language import op8_language
from voxmap.llm.op9_quality import op9_quality
from voxmap.llm.op10_tokenfile import op10_tokenfile

QUERIES = {f.__name__: f for f in (op1_resharding, op2_decontaminate, op3_lines, op4_html, op5_cosine, op6_packing, op7_minhash, op8_language, op9_quality, op10_tokenfile)}
ORACLE: dict[str, str] = {"op5_cosine": _op5.SQL, "op7_minhash": _op7.SQL}
