"""The operators applied to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from access_engine.llm import chat, decontaminate, licenses, mixing, periods, pii, quality, repeats, search, sharding, simhash, tokens, trie

QUERIES = {
    "op1_quality": quality.query,
    "op2_simhash": simhash.query,
    "op3_chat": chat.query,
    "op4_pii": pii.query,
    "op5_search": search.query,
    "op6_decontaminate": decontaminate.query,
    "op7_mixing": mixing.query,
    "op8_sharding": sharding.query,
    "op9_tokens": tokens.query,
    "op10_repeats": repeats.query,
    "op11_periods": periods.query,
    "op12_licenses": licenses.query,
    "op13_trie": trie.query,
}
ORACLE = {
    "op3_chat": chat.SQL,
    "op5_search": search.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_mixing": mixing.SQL,
    "op8_sharding": sharding.SQL,
    "op10_repeats": repeats.SQL,
    "op11_periods": periods.SQL,
    "op13_trie": trie.SQL,
}
