"""The logical plan that every front end compiles to, and the fluent builder."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Plan:
    source: str
    as_of: int | None = None
    valid_as_of: str | None = None
    where: tuple[tuple[str, str, object], ...] = ()
    search: str | None = None
    order_by: tuple[str, bool] | None = None
    traverse: str | None = None
    trace: bool = False
    trace_reverse: bool = False
    limit: int | None = None
    offset: int = 0
    group_by: str | None = None
    aggregate: tuple[str, str | None] | None = None
    columns: tuple[str, ...] | None = None
    like: tuple[tuple[str, str, bool], ...] = ()
    nulls: tuple[tuple[str, bool], ...] = field(default=())


class Query:
    """Query('users').where('age', '>=', 25).order_by('age', desc=True).limit(10).plan"""

    def __init__(self, source: str, plan: Plan | None = None):
        self.plan = plan or Plan(source)

    def _with(self, **changes) -> Query:
        return Query(self.plan.source, replace(self.plan, **changes))

    def as_of(self, seq: int) -> Query:
        return self._with(as_of=seq)

    def valid_as_of(self, date: str) -> Query:
        return self._with(valid_as_of=date)

    def where(self, name: str, op: str, value) -> Query:
        return self._with(where=(*self.plan.where, (name, op, value)))

    def search(self, text: str) -> Query:
        return self._with(search=text)

    def order_by(self, name: str, desc: bool = False) -> Query:
        return self._with(order_by=(name, desc))

    def traverse(self, rel: str) -> Query:
        return self._with(traverse=rel)

    def trace(self, reverse: bool = False) -> Query:
        return self._with(trace=True, trace_reverse=reverse)

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def group_by(self, name: str, function: str = "COUNT", of: str | None = None) -> Query:
        return self._with(group_by=name, aggregate=(function.upper(), of))

    def run(self, store):
        from palimpsest.plans.lower import run

        return run(self.plan, store)
