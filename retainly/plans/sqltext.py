"""Oracle SQL assembly: canonical views and derived inputs as CTEs."""

from __future__ import annotations

from ..sources.views import VIEW_SQL


def oracle(body: str, views=(), **extra: str) -> str:
    """`WITH <views>, <extra> <body>`; a body starting with WITH is merged."""
    parts = [f"{n} AS ({VIEW_SQL[n].strip()})" for n in views]
    parts += [f"{k} AS ({v.strip()})" for k, v in extra.items()]
    body = body.strip()
    if not parts:
        return body
    head = ",\n".join(parts)
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def r6(expr: str) -> str:
    """ROUND to 6 places; `+ 0.0` folds DuckDB's -0.0 into 0.0 (Spark's
    decimal rounding never yields a negative zero)."""
    return f"(ROUND({expr}, 6) + 0.0)"
