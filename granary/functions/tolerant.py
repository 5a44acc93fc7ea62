"""Column functions that read loosely typed values and never fail: numbers, amounts, dates, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of a price by urgency and by type of work, in the order of the price list.
URGENCY = {"Normal": 1.0, "Urgente": 1.5, "Ultra-urgente": 2.2}
JOB_TYPE = {"Apunte": 1.0, "Tarea": 1.2, "Guía": 1.3, "Resumen": 0.8, "Otro": 1.0}
BASE_PRICE = 50.0
COMPLEXITY = 0.015
ADVANCE = 0.5
#: Date patterns in the order they are tried; single letters also read days and months of one digit.
DATE_PATTERNS = ("d/M/yyyy", "yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS")


def safe_int(value: Column) -> Column:
    """A whole number of at least 1: the text as a number, cut at the point; 1 for anything else."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.greatest(F.lit(1).cast("long"), F.coalesce(number.try_cast("long"), F.lit(1).cast("long")))


def safe_amount(value: Column) -> Column:
    """The value as a double; 0 for null and for what is no number."""
    return F.coalesce(F.trim(value.cast("string")).try_cast("double"), F.lit(0.0))


def parse_date(value: Column) -> Column:
    """The first pattern that reads the text, then ISO 8601 at large; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in DATE_PATTERNS], F.try_to_timestamp(value))


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    """The value of ``key`` in a small fixed table, else ``default``."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def money(value: Column) -> Column:
    """Two decimals, by whole cents, so that 65.97499.. stays below the half as it does in binary arithmetic."""
    return F.round(value * 100, 0) / 100


def price(pages: Column, urgency: Column, job_type: Column, base: float = BASE_PRICE) -> Column:
    """Base times pages, urgency, type and a complexity that grows with the pages, to two decimals; unknown keys count 1."""
    n = safe_int(pages)
    return money(base * n * lookup(URGENCY, urgency, 1.0) * lookup(JOB_TYPE, job_type, 1.0) * (1 + COMPLEXITY * n))


def price_breakdown(pages: Column, urgency: Column, job_type: Column, base: float = BASE_PRICE) -> Column:
    """The pages' base price, every factor, the total and the advance."""
    n, total = safe_int(pages), price(pages, urgency, job_type, base)
    return F.struct(
        money(base * n).alias("base"), lookup(URGENCY, urgency, 1.0).alias("urgency_multiplier"), lookup(JOB_TYPE, job_type, 1.0).alias("type_multiplier"),
        F.round(1 + COMPLEXITY * n, 3).alias("complexity_factor"), total.alias("total"), money(total * ADVANCE).alias("advance_suggested"),
    )


# Fixed value: the text of a quote.
QUOTE = (
    "Hola {client} 👋\n\nTe comparto la cotización para tu {type}:\n\n📄 Páginas: {pages}\n⚡ Urgencia: {urgency}\n💰 Total: ${total} MXN\n"
    "💳 Anticipo (50%): ${advance} MXN\n📅 Entrega: {deadline}\n\n¿Te parece bien? Confirma para empezar. ✅"
)
NO_DEADLINE = "Por acordar"


def quote_message(client: Column, job_type: Column, pages: Column, urgency: Column, deadline: Column, total: Column) -> Column:
    """The quote's text with its facts; amounts have thousands separators and two decimals, a null fact is empty."""
    late = F.when(F.coalesce(deadline, F.lit("")) == "", NO_DEADLINE).otherwise(deadline)
    facts = {"client": client, "type": F.lower(job_type), "pages": pages, "urgency": urgency, "total": F.format_number(total, 2), "advance": F.format_number(money(total * ADVANCE), 2), "deadline": late}
    out = F.lit(QUOTE)
    for name, value in facts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
