"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import content_sort, host_paths, jump_shards, line_rules, noisy_channel, personal_data, prefix_bpe, prefix_join, size_packing, token_files

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_noisy_channel": noisy_channel.query,
    "op3_personal_data": personal_data.query,
    "op4_jump_shards": jump_shards.query,
    "op5_size_packing": size_packing.query,
    "op6_prefix_bpe": prefix_bpe.query,
    "op7_content_sort": content_sort.query,
    "op8_host_paths": host_paths.query,
    "op9_line_rules": line_rules.query,
    "op10_prefix_join": prefix_join.query,
    "line_rules_low_limits": line_rules.low_query,
}

ORACLES = {
    "op7_content_sort": content_sort.ORACLE,
    "op9_line_rules": line_rules.ORACLE,
    "op10_prefix_join": prefix_join.ORACLE,
    "line_rules_low_limits": line_rules.LOW_ORACLE,
}
