"""The registered queries of this subpackage and the DuckDB twins of those SQL can express."""

from __future__ import annotations

from proxima.llm.ann import op4_nearest
from proxima.llm.chat import op1_chat
from proxima.llm.decontam import op10_decontamination
from proxima.llm.langid import op8_language_id
from proxima.llm.licences import op5_licences
from proxima.llm.lines import op6_line_dedup
from proxima.llm.negatives import op12_negatives
from proxima.llm.oracles import ORACLES  # noqa: F401  (read by the entry)
from proxima.llm.pieces import op7_sentencepiece
from proxima.llm.pii import op2_pii
from proxima.llm.quality import op9_quality
from proxima.llm.repair import op11_repair
from proxima.llm.secrets import op13_secrets
from proxima.llm.simhash import op3_simhash

QUERIES = {
    "op1_chat": op1_chat,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_nearest": op4_nearest,
    "op5_licences": op5_licences,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_repair": op11_repair,
    "op12_negatives": op12_negatives,
    "op13_secrets": op13_secrets,
}
