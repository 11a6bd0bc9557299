"""Deterministic stand-ins for two model providers, for the registered queries and tests.

The first answers only prompts of even length, so the second is exercised as a
fallback; both read the whole prompt. ``reply_sql`` is the same rule in SQL.
"""

from __future__ import annotations

import hashlib

from ..operators.inference import ProviderFactory


def _primary():
    import pandas as pd

    def answer(prompts):
        return pd.Series([
            f"primary:{hashlib.sha1(p.encode()).hexdigest()[:12]}:{len(p)}" if len(p) % 2 == 0 else ""
            for p in prompts], index=prompts.index)

    return answer


def _fallback():
    import pandas as pd

    def answer(prompts):
        return pd.Series([f"fallback:{hashlib.md5(p.encode()).hexdigest()[:12]}:{p.count(chr(10))}"
                          for p in prompts], index=prompts.index)

    return answer


def stub_providers() -> list[tuple[str, ProviderFactory]]:
    return [("PrimaryStub", _primary), ("FallbackStub", _fallback)]


def reply_sql(prompt: str) -> str:
    return (f"CASE WHEN length({prompt}) % 2 = 0 THEN 'primary:' || substring(sha1({prompt}), 1, 12) || ':' || CAST(length({prompt}) AS VARCHAR) "
            f"ELSE 'fallback:' || substring(md5({prompt}), 1, 12) || ':' || CAST(length({prompt}) - length(replace({prompt}, chr(10), '')) AS VARCHAR) END")


def provider_sql(prompt: str) -> str:
    return f"CASE WHEN length({prompt}) % 2 = 0 THEN 'PrimaryStub' ELSE 'FallbackStub' END"
