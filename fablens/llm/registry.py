"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, dac, decontaminate, divergence, embeddings, encode, langid, licenses, pii, runs, setjoin, substrings, warc

QUERIES = {
    "op1_chat_format": chat.op1,
    "op2_suffix_dedup": substrings.op2,
    "op3_embedding_dedup": embeddings.op3,
    "op4_license_scan": licenses.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_pii": pii.op6,
    "op7_language_id": langid.op7,
    "op8_bpe_encode": encode.op8,
    "op9_jaccard_join": setjoin.op9,
    "op10_token_binary": dac.op10,
    "op11_periodic_runs": runs.op11,
    "op12_source_divergence": divergence.op12,
    "op13_warc_zip": warc.op13,
}
ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_suffix_dedup": substrings.OP2_SQL,
    "op3_embedding_dedup": embeddings.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op9_jaccard_join": setjoin.OP9_SQL,
    "op11_periodic_runs": runs.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_warc_zip": warc.OP13_SQL,
}
