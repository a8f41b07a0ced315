from test_operators import hits, roots, slow_fingerprint

__all__ = ["hits", "roots", "slow_fingerprint"]
