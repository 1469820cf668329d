"""The registered queries of this package and the plain SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    decontaminate,
    fingerprint,
    host_rules,
    language,
    lexical_search,
    manifest,
    mix,
    secret_scan,
    shard,
    signature_tree,
    toxicity,
    url_filter,
    warc,
)

QUERIES = {
    "op1_mix_sources": mix.op1,
    "op2_toxicity": toxicity.op2,
    "op3_jaccard_join": signature_tree.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_fingerprints": fingerprint.op5,
    "op6_url_rules": url_filter.op6,
    "op7_warc_round_trip": warc.op7,
    "op8_language": language.op8,
    "op9_rendezvous_shards": shard.op9,
    "op10_secret_scan": secret_scan.op10,
    "op11_host_rules": host_rules.op11,
    "op12_merkle_manifest": manifest.op12,
    "op13_lexical_search": lexical_search.op13,
}

ORACLES = {
    "op1_mix_sources": mix.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op6_url_rules": url_filter.OP6_SQL,
    "op7_warc_round_trip": warc.OP7_SQL,
    "op11_host_rules": host_rules.OP11_SQL,
    "op12_merkle_manifest": manifest.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
