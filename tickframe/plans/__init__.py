from tickframe.plans.windows import SCOPES, bar_window, cluster_by_symbol, running_window, scope_keys

__all__ = ["SCOPES", "bar_window", "cluster_by_symbol", "running_window", "scope_keys"]
