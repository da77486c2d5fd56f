"""Explicit schemas of the engine's tables (additive evolution by Parquet schema merging)."""

from __future__ import annotations

DEPTH_LEVEL = "struct<price:double,quantity:bigint,orders:bigint>"
GREEKS = "struct<delta:double,gamma:double,theta:double,vega:double,rho:double,iv:double>"
TICK = (
    "token bigint, seq bigint, ts_ns bigint, exchange_ns bigint, last_price double, last_quantity bigint, "
    "total_volume bigint, vwap double, open_interest double, bid_price double, bid_size bigint, ask_price double, "
    f"ask_size bigint, bids array<{DEPTH_LEVEL}>, asks array<{DEPTH_LEVEL}>, greeks {GREEKS}"
)
CANDLE = "symbol string, interval string, ts_ns bigint, open double, high double, low double, close double, volume bigint, open_interest bigint"
BACKTEST_TICK = "ts_ns bigint, token bigint, last_price float, bid_price float, ask_price float, vwap float, volume bigint"
ENHANCED_BAR = (
    "ts_ns bigint, token bigint, open double, high double, low double, close double, volume bigint, open_interest double, vwap double, "
    "buy_volume bigint, sell_volume bigint, tick_count bigint, bar_ofi double"
)
SIGNAL = "ts_ns bigint, token bigint, price double, action int, confidence double, strategy_id int"
INSTRUMENT = (
    "date date, instrument_key string, trading_symbol string, name string, exchange string, segment string, lot_size int, "
    "tick_size double, instrument_type string, expiry_ms bigint, strike_price double"
)
