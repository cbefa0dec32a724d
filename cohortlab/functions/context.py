"""Look-ups in a free-key case context held as VARIANT.

An absent key is SQL NULL; a key that is present with a JSON null is a non-NULL
variant null. ``coalesce`` over variants therefore means "first present key", null
included, which a plain nullable column could not express.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from cohortlab.functions.numeric import text_number
from cohortlab.functions.text import normalize_text

# Nested maps that override the top level, last one wins.
NESTED = ("pathology", "mri_features", "biomarkers")


@dataclass(frozen=True)
class Value:
    """Columns of one looked-up key.

    ``kind`` is NULL for an absent key, else BOOLEAN, NUMBER, TEXT, NULL or OTHER.
    ``text`` is the scalar as text; ``number`` the finite number of a number or a
    numeric text, ``variant`` the value as it is. ``plain`` and ``spaced`` are there once ``fold`` has added them.
    """

    kind: Column
    text: Column
    number: Column
    variant: Column
    plain: Column | None = None
    spaced: Column | None = None

    def folded(self, hyphens: bool = False) -> Column:
        """The text normalised: the column that holds it, else the expression."""
        made = self.spaced if hyphens else self.plain
        return normalize_text(self.text, hyphens) if made is None else made

    @property
    def missing(self) -> Column:
        """Absent or null."""
        return F.coalesce(self.kind, F.lit("NULL")) == "NULL"

    @property
    def listed(self) -> Column:
        """The text, or the texts of a list, joined."""
        items = F.try_variant_get(self.variant, "$", "array<string>")
        return F.when(items.isNotNull(), F.concat_ws(" ", items)).otherwise(self.text)


@dataclass(frozen=True)
class Wanted:
    """A key, or aliases of which the first present one counts, of a context."""

    context: Context
    names: tuple[str, ...]


@dataclass
class Context:
    """Reads keys of a VARIANT column; ``defaults`` fill only absent keys."""

    column: str = "context"
    nested: tuple[str, ...] = NESTED
    defaults: dict[str, Column] = field(default_factory=dict)

    def paths(self) -> list[str]:
        """The objects a key is looked up in, in order: nested ones, the last of them first, then the top level."""
        return [f"$.{outer}" for outer in reversed(self.nested)] + ["$"]

    def objects(self) -> list[Column]:
        return [F.try_variant_get(self.column, path, "variant") for path in self.paths()[:-1]] + [F.col(self.column)]

    def get(self, name: str) -> Wanted:
        return self.first((name,))

    def first(self, names) -> Wanted:
        """First present key among the aliases; nested maps before the top level, a default after them."""
        return Wanted(self, tuple(names))


# Kinds by the type that Spark names (its first seven letters, so without a decimal's digits), the usual ones first; any other one is OTHER.
KINDS = {"STRING": "TEXT", "DECIMAL": "NUMBER", "BIGINT": "NUMBER", "DOUBLE": "NUMBER", "BOOLEAN": "BOOLEAN", "VOID": "NULL",
         **dict.fromkeys(("INT", "SMALLIN", "TINYINT", "FLOAT"), "NUMBER")}


def _kind(v: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.substring(F.schema_of_variant(v), 1, 7)), F.when(v.isNotNull(), "OTHER"))


def stage(df: DataFrame, wanted: dict[str, Wanted]) -> tuple[DataFrame, dict[str, Value], list[str]]:
    """Look keys up as kind, text and number, one projection per step.

    Returns the frame, the values by name, and the helper columns to drop later. The nested objects are taken
    out once, straight from the context (as variants of their own, each with a dictionary to build, only for keys
    that a struct cannot name), all wanted keys of an object in one pass over the keys it has, and each value is read
    once, however many rules look at it. (A look-up by path costs an exception for each key that an object has not.)

    Kinds and texts are read in the projection that looks the values up. The opened objects make it so wide that Spark splits its
    code into small methods; a step of its own would be one method, which the JVM never compiles once it has over 8,000 bytes
    (some 20 keys).
    """
    names, (context,) = list(wanted), {id(w.context): w.context for w in wanted.values()}.values()
    keys = list(dict.fromkeys(n for w in wanted.values() for n in w.names))
    fields = [n for n in keys if n.isidentifier() and sum(n.lower() == k.lower() for k in keys) == 1]
    shape = f"struct<{', '.join(f'`{n}`: variant' for n in fields)}>"
    objects = {f"x__{i}": o for i, o in enumerate(context.objects())}
    opened = {f"{o}_f": F.try_variant_get(context.column, path, shape) for o, path in zip(objects, context.paths())} if fields else {}

    def found(aliases: tuple[str, ...]) -> Column:
        parts = []
        for n in aliases:
            parts += [F.col(f"{o}_f").getField(n) if n in fields else F.try_variant_get(o, f"$.{n}", "variant") for o in objects]
            parts += [context.defaults[n].cast("variant")] if n in context.defaults else []
        return F.coalesce(*parts)

    df, variants = df.withColumns({**(objects if len(fields) < len(keys) else {}), **opened}), {n: found(w.names) for n, w in wanted.items()}
    read = {f"x_{n}{tail}": c for n, v in variants.items() for tail, c in (("", v), ("_k", _kind(v)), ("_t", F.try_variant_get(v, "$", "string")))}
    df = df.withColumns(read).drop(*objects, *opened)
    df = df.withColumns({f"x_{n}_n": F.when(F.col(f"x_{n}_k").isin("NUMBER", "TEXT"), text_number(F.col(f"x_{n}_t"))) for n in names})
    col = lambda n, tail: F.col(f"x_{n}{tail}")
    return df, {n: Value(col(n, "_k"), col(n, "_t"), col(n, "_n"), col(n, "")) for n in names}, [f"x_{n}{t}" for n in names for t in ("", "_k", "_t", "_n")]


def fold(df: DataFrame, x: dict[str, Value], plain=(), spaced=()) -> tuple[DataFrame, dict[str, Value], list[str]]:
    """Normalise the texts of staged keys once (``spaced``: hyphens as blanks), for parsers that look at them several times.

    An expression that several branches of a CASE spell out is worked on in each of them. The texts are one list, normalised by one
    lambda: spelled out per key they would make a method that the JVM never compiles.
    """
    made, held = {}, {n: {} for n in x}
    for kind, names, norm in (("plain", plain, lambda t: normalize_text(t)), ("spaced", spaced, lambda t: normalize_text(t, hyphens=True))):
        if names:
            made[f"x__{kind}"] = F.transform(F.array(*[x[n].text for n in names]), norm)
        for i, n in enumerate(names):
            held[n][kind] = F.col(f"x__{kind}")[i]
    return df.withColumns(made), {n: replace(v, **held[n]) for n, v in x.items()}, list(made)


def fence(df: DataFrame) -> DataFrame:
    """Stop the optimizer from moving later filters into the steps before.

    A filter on a parsed value would otherwise be rewritten in terms of the raw row,
    with every intermediate step spelled out again for each place it is used.
    """
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("fenced")).select("fenced.*")
