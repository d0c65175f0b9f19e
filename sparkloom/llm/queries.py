"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from .ann import op1_ann
from .language import op9_language
from .linededup import op10_line_dedup
from .media import op3_media
from .mixing import OP6_SQL, op6_mix
from .neardup import op2_near_dup
from .packing import op5_packing
from .tokens import op7_token_counts
from .toxicity import op8_toxicity
from .warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_ann, op2_near_dup, op3_media, op4_warc, op5_packing, op6_mix, op7_token_counts, op8_toxicity, op9_language, op10_line_dedup)}
ORACLE = {"op6_mix": OP6_SQL}
