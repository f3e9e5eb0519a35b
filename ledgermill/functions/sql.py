"""The parsers as SQL functions: temporary ones, so that ledgers can be read by SQL text alone.

Each is made of the same steps as its column form.  A step becomes a function of its own that hands all values so far
to the next: Spark binds a function's arguments in a projection below its body, so each step is evaluated once.

Amounts, splits, balances and dates stand in a select list or a condition.  Sum them from a subquery that selects them:
Spark takes no expression into an aggregate that must stay where it is, as these must (see ``define``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.functions import udtf

from ..config import DATE_RULES, DateRules
from ..sources import files as Files
from ..sources.shipping import ship
from .amounts import amount_steps, split_steps
from .classify import format_of, transaction_type
from .dates import date_steps
from .text import Steps, clean_description, strip

CELLS = "line_no int, cells array<string>, delimiter string"


def sql_texts(spark: SparkSession, wanted: list[Column], parameters: str) -> list[tuple[str, str]]:
    """Expressions over ``parameters`` (a schema) as SQL text, and their types.  Lambdas have no such text."""
    found = spark.createDataFrame([], parameters).select(*[c.alias(f"c{i}") for i, c in enumerate(wanted)])
    made = found._jdf.queryExecution().analyzed().expressions()
    return [(made.apply(i).child().sql(), f.dataType.simpleString()) for i, f in enumerate(found.schema)]


def sql_text(spark: SparkSession, c: Column, parameters: str) -> tuple[str, str]:
    return sql_texts(spark, [c], parameters)[0]


def _define(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def define(spark: SparkSession, name: str, parameters: dict[str, str], steps: Steps | Column, defaults: dict[str, str] | None = None) -> None:
    """A temporary SQL function of ``parameters`` (name and type); ``defaults`` are SQL literals of the last ones."""
    held, bodies, value = dict(parameters), [], None
    while not isinstance(steps, Column):
        try:
            wanted = steps.send(value)
        except StopIteration as end:
            steps = end.value
            break
        several = wanted if isinstance(wanted, list) else [wanted]
        made = sql_texts(spark, several, ", ".join(f"{k} {t}" for k, t in held.items()))
        names = [f"{name}_v{len(held) + i}" for i in range(len(made))]
        bodies.append((dict(held), [text for text, _ in made]))
        held |= {n: kind for n, (_, kind) in zip(names, made, strict=True)}
        value = [F.col(n) for n in names] if isinstance(wanted, list) else F.col(names[0])
    body, returns = sql_text(spark, steps, ", ".join(f"{k} {t}" for k, t in held.items()))
    if bodies:
        # A condition on the result must not move below the steps, where it would write each out for every time it is
        # read: the result is an argument itself, so a projection of its own, and differs between tasks to the planner.
        _define(spark, f"{name}_found", f"found {returns}", returns, "found")
        body = f"{name}_found(CASE WHEN spark_partition_id() >= 0 THEN {body} END)"
    # The last step first: a function's body may only call what is there.
    for n in range(len(bodies), -1, -1):
        own = held if n == len(bodies) else bodies[n][0]
        text = body if n == len(bodies) else f"{name}_{n + 1}({', '.join([*own, *bodies[n][1]])})"
        given = ", ".join(f"{k} {t}" + (f" DEFAULT {defaults[k]}" if defaults and n == 0 and k in defaults else "") for k, t in own.items())
        _define(spark, f"{name}_{n}" if n else name, given, returns, text)


def register(spark: SparkSession, rules: DateRules = DATE_RULES) -> None:
    """Defines, for the session:

    - ``ledger_amount(raw, default_direction = 'D')``, ``ledger_split(debit, credit)``, ``ledger_balance(raw)``
    - ``ledger_date(raw)`` and ``ledger_date_mdy(raw)``, which reads the month first
    - ``ledger_description(raw)``, ``ledger_type(explicit, description, direction)``, ``ledger_bank_format(headers)``
    - the table functions ``ledger_cells(text)``, the records of delimited text, and ``ledger_records(text)``, those of
      them that hold anything
    """
    text, raw = "string", F.col("raw")
    one: dict[str, Callable[[], Steps | Column]] = {
        "ledger_date": lambda: date_steps(raw, True, rules), "ledger_date_mdy": lambda: date_steps(raw, False, rules), "ledger_description": lambda: clean_description(raw),
    }
    for name, made in one.items():
        define(spark, name, {"raw": text}, made())
    define(spark, "ledger_amount", {"raw": text, "default_direction": text}, amount_steps(raw, F.col("default_direction")), {"default_direction": "'D'"})
    define(spark, "ledger_split", {"debit": text, "credit": text}, split_steps(F.col("debit"), F.col("credit")))
    _define(spark, "ledger_balance", "raw string", "decimal(38,10)", "ledger_amount(raw, 'C').value")
    define(spark, "ledger_type", {"explicit": text, "description": text, "direction": text}, transaction_type(F.col("explicit"), F.col("description"), F.col("direction")))
    define(spark, "ledger_bank_format_low", {"low": "array<string>"}, format_of(F.col("low")))
    stripped, _ = sql_text(spark, F.lower(strip(F.col("h"))), "h string")
    _define(spark, "ledger_bank_format", "headers array<string>", text, f"ledger_bank_format_low(transform(headers, h -> {stripped}))")

    ship(spark)

    @udtf(returnType=CELLS)
    class Cells:
        def eval(self, text: str):
            yield from Files.records(text) if text else ()

    spark.udtf.register("ledger_cells", Cells.asDeterministic())
    filled, _ = sql_text(spark, strip(F.col("c")) != "", "c string")
    _define(spark, "ledger_records", "content string", f"TABLE ({CELLS})", f"SELECT line_no, cells, delimiter FROM ledger_cells(content) WHERE exists(cells, c -> {filled})")
