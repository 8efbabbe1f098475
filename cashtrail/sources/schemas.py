"""Explicit schemas of the file sources; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LEDGER = _struct(
    txn_id=_S, complaint_id=_S, src_account=_S, dst_account=_S, bank_name=_S, ifsc_code=_S, city=_S, district=_S,
    state=_S, lat=_D, long=_D, amount=_D, timestamp=_S, hop_depth=_I, is_terminal=_I, is_fraud=_I,
    txn_purpose=_S, cashout_atm_id=_S, time_to_cashout_min=_D)
COMPLAINTS = _struct(
    ticket_id=_S, victim_name=_S, victim_bank=_S, victim_account=_S, fraud_type=_S, stolen_amount=_D,
    complaint_timestamp=_S, city=_S, state=_S, status=_S)
CASHPOINTS = _struct(
    atm_id=_S, bank_name=_S, address=_S, city=_S, district=_S, state=_S, lat=_S, long=_S, opening_time=_S,
    closing_time=_S, cashout_risk_score=_D, historical_fraud_count=_I)
ACCOUNT_FEATURES = _struct(
    account_id=_S, bank_name=_S, city=_S, lat=_D, long=_D, total_received=_D, total_sent=_D, txn_count_24h=_I,
    avg_txn_amount=_D, in_degree=_I, out_degree=_I, distinct_senders=_I, distinct_receivers=_I,
    median_dwell_seconds=_D, passthrough_ratio=_D, account_age_days=_I, night_txn_ratio=_D, burst_out_5min=_I,
    is_mule_label=_I, hop_depth=_I)
RECIPIENTS = _struct(name=_S, role=_S, channel=_S, address=_S, scope_state=_S, scope_district=_S)
REGISTRY = _struct(account_id=_S, source=_S, flagged_on=_S, note=_S)
CITIES = T.StructType([
    T.StructField("total", _L), T.StructField("cities", T.ArrayType(_S)),
    T.StructField("city_to_state", T.MapType(_S, _S)), T.StructField("aliases", T.MapType(_S, _S))])
LIVE_COMPLAINT = _struct(
    ticket_id=_S, victim_account=_S, fraud_type=_S, stolen_amount=_D, complaint_timestamp=_S, city=_S, state=_S)
LIVE_TRANSFER = _struct(txn_id=_S, src_account=_S, dst_account=_S, amount=_D, timestamp=_S)
