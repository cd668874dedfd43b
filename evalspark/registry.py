"""Names for what an evaluation is put together from: solvers, scorers and tasks, each a function over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("solver", "scorer", "task")
_entries: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str | None = None) -> Callable[[Callable], Callable]:
    """Decorator that enters a function under its own or the given name; a name is taken once."""
    if kind not in KINDS:
        raise ValueError(f"kind is {kind!r}; expected one of {KINDS}")

    def add(f: Callable) -> Callable:
        key = (kind, name or f.__name__)
        if _entries.get(key, f) is not f:
            raise ValueError(f"{kind} {key[1]!r} is registered already")
        _entries[key] = f
        return f

    return add


def resolve(kind: str, name: str) -> Callable:
    """The function of that name; an unknown name is an error that lists those there are."""
    try:
        return _entries[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; there are {names(kind)}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _entries if k == kind)


def _builtin() -> None:
    from .operators import scoring

    register("solver", "oracle")(scoring.oracle_answers)
    register("solver", "model")(scoring.call_model)
    register("scorer", "multiple_choice")(scoring.score_completions)

    @register("task", "multiple_choice")
    def multiple_choice(samples, solver: str = "oracle", style: str = "clean", **how):
        """Samples answered by a solver and scored."""
        return scoring.score_completions(resolve("solver", solver)(samples, style, **how), style)


_builtin()
