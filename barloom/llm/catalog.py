"""Registered queries of the text operators and their SQL twins."""

from barloom.llm import decontaminate, exact, html, language, lines, mixing, pii, repeats, sharding, simhash, spelling, urls, whitening

QUERIES = {
    "op1_language": language.op1_language,
    "op2_repeats": repeats.op2_repeats,
    "op3_sharding": sharding.op3_sharding,
    "op4_pii": pii.op4_pii,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_url_filter": urls.op9_url_filter,
    "op10_html": html.op10_html,
    "op11_spelling": spelling.op11_spelling,
    "op12_whitening": whitening.op12_whitening,
    "op13_lines": lines.op13_lines,
}
SQL = {
    "op3_sharding": sharding.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_exact_dedup": exact.OP8_SQL,
    "op9_url_filter": urls.OP9_SQL,
    "op13_lines": lines.OP13_SQL,
}
