"""The registered queries of the corpus operators and their SQL."""

from . import decontaminate, exact_dedup, jaccard_join, language_id, mixing, periodic_runs, quality_rules, quote_links, ranked_search, secret_scan, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_quote_links": quote_links.op4_quote_links,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_language_id": language_id.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLE = {
    "op1_warc": warc.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op4_quote_links": quote_links.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    "op11_periodic_runs": periodic_runs.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
