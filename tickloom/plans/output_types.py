"""Output column types where the two engines would differ.

DuckDB types integer literals, ranks and date differences differently from Spark, and exact money
comes back as DECIMAL; the SQL twin casts these columns to the type the Spark plan returns.
"""

DOUBLES = {
    "sql_scalars": "a",
    "statements_by_account": "balance_bf balance_cf",
    "account_summary_page": "commission",
    "monthly_account_summary": "balance_b_f balance_c_f deposit_withdrawal total_pnl commission client_equity "
                               "fund_available margin_occupied accumulated_pnl",
    "fund_flows": "amount",
    "fund_flow_identity": "balance_change flow_total",
    "fund_flow_breakdown": "amount",
    "statement_balance_check": "expected_closing discrepancy",
    "fund_balance_equation": "expected_cf",
    "name_resolution": "confidence",
}
INTEGERS = {
    "ranking_one_row_per_side": "rank",
    "ranking_merged_by_rank": "rank",
    "top_holders": "position",
    "top_members_of_day": "position",
    "institution_features": "member_rank_long member_rank_short",
    "date_gaps_per_account": "max_gap",
    "sync_batches": "batch_index total_batches",
}
BIGINTS = {
    "copy_verification": "extra_rows",
    "instrument_attributes": "multiplier",
    "fifo_matched_trades": "multiplier",
    "position_consistency": "negative_volume empty_member",
    "minute_completeness": "expected_count",
    "recorded_vs_actual_totals": "drift",
    "quality_overview": "drift",
    "dashboard_summary": "total_tables",
}


def typed(name: str, sql: str) -> str:
    casts = [f'CAST({c} AS {kind}) AS {c}' for kind, table in
             (("DOUBLE", DOUBLES), ("INTEGER", INTEGERS), ("BIGINT", BIGINTS)) for c in table.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS typed_result" if casts else sql
