"""Default parameters. All are fixed values and can be passed explicitly to the operators."""

from __future__ import annotations

STAGE1_WEIGHTS = {"revenue": 0.20, "profitability": 0.25, "valuation": 0.15, "flow": 0.20, "momentum": 0.20}
STAGE2_WEIGHTS = {
    "dividend": 0.20, "announcements": 0.16, "shareholders": 0.12, "pledge": 0.16,
    "penalties": 0.12, "news_sentiment": 0.12, "earnings_growth": 0.12,
}
REGIME_WEIGHTS = {
    "normal": {"revenue": 0.25, "profitability": 0.20, "valuation": 0.10, "flow": 0.25, "momentum": 0.20},
    "caution": {"revenue": 0.20, "profitability": 0.20, "valuation": 0.20, "flow": 0.20, "momentum": 0.20},
    "stress": {"revenue": 0.15, "profitability": 0.25, "valuation": 0.25, "flow": 0.20, "momentum": 0.15},
    "crisis": {"revenue": 0.10, "profitability": 0.25, "valuation": 0.30, "flow": 0.20, "momentum": 0.15},
}
POSITION_MULTIPLIER = {"normal": 1.0, "caution": 0.6, "stress": 0.3, "crisis": 0.1, "black_swan": 0.0}
REGIME_TIERS = ("black_swan", "crisis", "stress", "caution", "normal")
LEGACY_REGIMES = ("bull", "choppy", "bear", "no_trade", "unknown")
MIN_REGIME_DAYS = 5

THRESHOLDS = {
    "pass": 60.0, "watchlist": 45.0, "min_market_cap": 30e9, "min_market_cap_second": 20e9, "min_adv": 50e6,
    "price_floor": 15.0, "price_ceiling": 3000.0, "min_listing_years": 2.0, "max_pledge_ratio": 0.30, "penalty_days": 365,
}
FUNDAMENTAL_MIN = 65.0
MAX_WEIGHT_CHANGE, MIN_WEIGHT, MAX_WEIGHT = 0.05, 0.05, 0.50
MAX_SECTOR_SHARE = 0.25
