"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from passbook.llm.ann import op9_ann
from passbook.llm.bpe import op10_byte_bpe
from passbook.llm.chat import OP5_SQL, op5_chat
from passbook.llm.decontaminate import op3_decontaminate
from passbook.llm.merkle import op13_merkle
from passbook.llm.mixture import OP12_SQL, op12_mixture
from passbook.llm.pii import op2_pii
from passbook.llm.quality import op4_quality
from passbook.llm.simhash import op7_simhash
from passbook.llm.spelling import op11_spelling
from passbook.llm.sql import OP11_SQL, OP13_SQL
from passbook.llm.token_blocks import op8_token_blocks
from passbook.llm.toxicity import op1_toxicity
from passbook.llm.urls import op6_urls

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_urls": op6_urls,
    "op7_simhash": op7_simhash,
    "op8_token_blocks": op8_token_blocks,
    "op9_ann": op9_ann,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling": op11_spelling,
    "op12_mixture": op12_mixture,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {"op5_chat": OP5_SQL, "op11_spelling": OP11_SQL, "op12_mixture": OP12_SQL, "op13_merkle": OP13_SQL}
