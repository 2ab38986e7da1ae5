"""Multi-step plans: research stages and backtests."""
