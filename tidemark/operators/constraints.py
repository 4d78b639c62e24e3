"""Declared constraints, checked together: each table is read once, all keys meet in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    """No two rows of equal columns, among those that meet the condition; rows with a null in them are free."""

    columns: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class Reference:
    """The columns are null or name a row of another table by its columns."""

    columns: tuple[str, ...]
    table: str
    to: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """What holds for a table. A check is a condition that no row makes false; null is let through."""

    needed: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    unique: dict[str, Unique] = field(default_factory=dict)
    references: dict[str, Reference] = field(default_factory=dict)


METRICS = ("views", "likes", "comments", "shares")
#: The store's tables.
SCHEMA = {
    "clients": Rules(("client_id", "name"), unique={"client_key": Unique(("client_id",))}),
    "providers": Rules(("provider_id", "name"), unique={"provider_key": Unique(("provider_id",)), "provider_name": Unique(("name",))}),
    "accounts": Rules(
        ("account_id", "platform_handle", "provider_id"), unique={"account_key": Unique(("account_id",)), "handle_of_provider": Unique(("platform_handle", "provider_id"))},
        references={"account_provider": Reference(("provider_id",), "providers", ("provider_id",))},
    ),
    "ownership": Rules(
        ("account_id", "client_id", "valid_from"), {"period_forward": "valid_to is null or valid_to > valid_from"}, {"one_open_owner": Unique(("account_id",), "valid_to is null")},
        {"owned_account": Reference(("account_id",), "accounts", ("account_id",)), "owning_client": Reference(("client_id",), "clients", ("client_id",))},
    ),
    "posts": Rules(
        ("post_id", "account_id", "platform_post_id", "provider_id"), unique={"post_key": Unique(("post_id",)), "post_of_provider": Unique(("platform_post_id", "provider_id"))},
        references={"post_account": Reference(("account_id",), "accounts", ("account_id",)), "post_provider": Reference(("provider_id",), "providers", ("provider_id",))},
    ),
    "runs": Rules(
        ("run_id", "provider_id", "started_at", "status"), {"run_status": "status in ('running', 'completed', 'failed', 'partial')"}, {"run_key": Unique(("run_id",))},
        {"run_provider": Reference(("provider_id",), "providers", ("provider_id",))},
    ),
    "run_accounts": Rules(
        ("run_id", "account_id"), unique={"account_of_run": Unique(("run_id", "account_id"))},
        references={"counted_run": Reference(("run_id",), "runs", ("run_id",)), "counted_account": Reference(("account_id",), "accounts", ("account_id",))},
    ),
    "snapshots": Rules(
        ("post_id", "run_id", "scraped_at", *METRICS), {f"{m}_not_negative": f"{m} >= 0" for m in METRICS},
        references={"snapshot_post": Reference(("post_id",), "posts", ("post_id",)), "snapshot_run": Reference(("run_id",), "runs", ("run_id",))},
    ),
}


class BrokenConstraint(ValueError):
    """Rows that declared rules refuse."""


def _key(columns: tuple[str, ...]) -> Column:
    """The columns as one text, null if one of them is; before each but the last stands its length, so that different columns never look alike."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for t in texts[:-1] for x in (F.length(t).cast("string"), F.lit(":"), t)], texts[-1])


def violations(tables: dict[str, DataFrame], rules: dict[str, Rules] = SCHEMA) -> DataFrame:
    """rule, n for every declared rule of the given tables, 0 too.

    n counts rows that break a check, lack a needed value (rule ``<table>.<column>``) or name
    no row of the other table, and keys that stand twice.  Rules on tables that aren't
    given are left out; so is a reference to one.

    Every row yields the checks that it breaks and its keys, each in the key space (table and
    columns) that it belongs to; a row that is referred to yields the key there, too.  One
    aggregation by space and key, combined before the shuffle, tells repeated keys and references
    without a row.  It keeps one count for a key's own rows and one for each reference to its
    space, so a key's memory doesn't grow with the rules of other spaces.  A key that very many
    rows have costs a row a task.
    """
    spaces: dict[tuple, int] = {}
    space = lambda *of: spaces.setdefault(of, len(spaces))
    unique: dict[str, int] = {}
    refer: dict[str, tuple[int, int]] = {}
    checks: dict[str, Column] = {}
    #: space, which of its counts (0: own rows), key
    facts: dict[str, list[tuple[int, int, Column]]] = {t: [] for t in tables}
    needs: dict[str, dict[str, Column]] = {}
    for t in tables:
        own = rules.get(t, Rules())
        needs[t] = {f"{t}.{c}": F.col(c).isNull() for c in own.needed} | {name: ~F.expr(c) for name, c in own.checks.items()}
        checks |= needs[t]
        for name, u in own.unique.items():
            unique[name] = space(t, u.columns, u.where)
            facts[t].append((unique[name], 0, F.when(F.expr(u.where or "true"), _key(u.columns))))
    for t in tables:
        for name, r in rules.get(t, Rules()).references.items():
            if r.table not in tables:
                continue
            if (r.table, r.to, None) not in spaces:
                facts[r.table].append((space(r.table, r.to, None), 0, _key(r.to)))
            own = space(r.table, r.to, None)
            refer[name] = own, 1 + sum(s == own for s, _ in refer.values())
            facts[t].append((*refer[name], _key(r.columns)))
    counts = range(1 + max((at for _, at in refer.values()), default=0))

    def yielded(t: str, df: DataFrame) -> DataFrame:
        """space, key, at (which count); a broken check is a key, its name, of space -1."""
        broken = [F.struct(F.lit(-1).alias("space"), F.when(c, F.lit(name)).alias("key"), F.lit(0).alias("at")) for name, c in needs[t].items()]
        keys = [F.struct(F.lit(s).alias("space"), key.alias("key"), F.lit(at).alias("at")) for s, at, key in facts[t]]
        return df.select(F.inline(F.array(*broken, *keys))).where("key is not null")

    every = reduce(DataFrame.unionByName, [yielded(t, df) for t, df in tables.items() if needs[t] or facts[t]])
    per_key = every.groupBy("space", "key").agg(*[F.count_if(F.col("at") == i).alias(f"n{i}") for i in counts])
    within = lambda s, more, n: F.coalesce(F.sum(F.when((F.col("space") == s) & more, F.col(n))), F.lit(0))
    found = [within(-1, F.col("key") == name, "n0").alias(name) for name in checks]
    found += [F.count_if((F.col("space") == s) & (F.col("n0") > 1)).alias(name) for name, s in unique.items()]
    found += [within(s, F.col("n0") == 0, f"n{at}").alias(name) for name, (s, at) in refer.items()]
    names = [*checks, *unique, *refer]
    return per_key.agg(*found).select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").cast("long").alias("n")) for n in names])))


def require(tables: dict[str, DataFrame], rules: dict[str, Rules] = SCHEMA) -> None:
    """Raises BrokenConstraint with the rules that are broken and how often; only those reach the driver."""
    broken = {r.rule: r.n for r in violations(tables, rules).where("n > 0").collect()}
    if broken:
        raise BrokenConstraint(", ".join(f"{rule}: {n}" for rule, n in sorted(broken.items())))
