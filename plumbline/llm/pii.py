"""Personal data: regular expressions propose, checksums confirm, context words adjust. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.llm.common import ascii_lower

#: The base kinds in their order, as Java expressions that match exactly what the contract's match. They start only
#: where the contract's leftmost match can start and never give back what can't help, so long runs stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: The method's own kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Base score of a kind, the gain of a passed validator, and the words nearby that raise the score.
KINDS = [
    ("email", EMAIL, 0.6, ["mail", "contact", "e-mail", "write"]),
    ("ip", IP, 0.5, ["ip", "host", "server", "address"]),
    ("card", CARD, 0.5, ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"]),
    ("phone", PHONE, 0.5, ["phone", "tel", "call", "mobile", "fax"]),
    ("iban", IBAN, 0.5, ["iban", "account", "bank", "konto", "compte", "cuenta"]),
    ("ssn", SSN, 0.3, ["ssn", "social", "security", "tax"]),
]
BASE = ("email", "ip", "card", "phone")
CONTEXT_GAIN, WINDOW, REPORT = 0.3, 40, 0.5


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda sum_, i: sum_ + _doubled(F.substring(digits, -i, F.lit(1)).cast("int"), i % 2 == 0),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)


def mod97(iban: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 by 97, letters counting as 10 to 35."""
    flat = F.translate(iban, " ", "")
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, F.lit(1), F.lit(4)))

    def fold(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), fold) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), -4, 4).cast("int") <= 255))
    if kind == "card":
        d = digits_of(text)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(text)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.translate(text, " ", "")).between(15, 34), mod97(text)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~F.substring(text, 1, 3).isin("000", "666") & ~text.startswith("9") & (F.substring(text, 5, 2) != "00") & (F.substring(text, 8, 4) != "0000")
    return F.lit(True)


#: A cheap test that a text without a match mostly fails.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": "+", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}


#: Matches whose places are summed up at once; blocks of text (code points) from which context is cut.
RUN, BLOCK = 128, 1024
SPAN = "array<struct<start:int,stop:int,hit:string>>"


def _walk(spans: Column) -> Column:
    """(length, places) of a run of (gap, hit): how many code points it covers, and where its hits lie in it."""

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        put = F.when(x["hit"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit")))))
        return F.struct(stop.alias("at"), put.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)


def _found(kind: str, expression: str, text: Column) -> Column:
    """All matches as (start, stop, hit): what a split leaves between them gives their places, in code points.

    Places are summed up in runs of ``RUN`` matches and the runs' starts over the runs, so that the work grows with
    the matches and not with their square.
    """
    hint = HINTS[kind]
    likely = F.contains(text, F.lit(hint)) if hint in ("@", "+") else text.rlike(hint)
    spans = F.arrays_zip(F.split(text, expression, -1).alias("gap"), F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("hit"))
    runs = let(spans, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda r: _walk(F.slice(x, r * RUN + 1, F.lit(RUN)))))
    starts = lambda r: F.aggregate(r, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["at"])))
    moved = lambda x: F.transform(x["run"]["out"], lambda h: F.struct((h["start"] + x["base"]).alias("start"), (h["stop"] + x["base"]).alias("stop"), h["hit"].alias("hit")))
    placed = let(runs, lambda r: F.flatten(F.transform(F.arrays_zip(r.alias("run"), F.slice(starts(r), F.lit(1), F.size(r)).alias("base")), moved)))
    return F.when(likely, placed).otherwise(F.array().cast(SPAN))


def _check(kind: str):
    return lambda x: _valid(kind, x["hit"])


def _ranked(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), x["hit"].alias("hit"))


def _score(blocks: Column):
    """Scores a span by its kind and by the words among the ``WINDOW`` characters on either side of it.

    ``blocks`` is the text in pieces of ``BLOCK`` characters, so that a window is cut from two of them and not sought
    from the text's start.
    """

    def cut(start: Column, stop: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        two = F.concat(F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, first + 1), F.lit("")))
        return F.substring(two, start - first * BLOCK + 1, stop - start)

    def scored(x: Column) -> Column:
        begin = F.greatest(F.lit(0), x["start"] - WINDOW)
        around = ascii_lower(F.concat(cut(begin, x["start"]), F.lit(" "), cut(x["stop"], x["stop"] + WINDOW)))

        def by_kind(text: Column) -> Column:
            score = F.lit(0.0)
            for rank, (kind, _, base, words) in enumerate(KINDS):
                near = text.rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")
                own = F.lit(base + 0.2 * (kind in ("card", "iban"))) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
                score = F.when(x["rank"] == rank, own).otherwise(score)
            return F.round(F.least(score, F.lit(1.0)), 2)

        kinds = F.array(*[F.lit(k[0]) for k in KINDS])
        return F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"), F.get(kinds, x["rank"]).alias("kind"), x["hit"].alias("hit"), let(around, by_kind).alias("score")
        )

    return scored


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` plus an array of (start, stop, rank, kind, hit, score), by start and then the order of ``KINDS``.

    Matches are leftmost and non-overlapping for each kind; starts and ends are code points, the end exclusive. A
    match that its validator refuses is dropped and what it covered is not tried again: parts of at most 255 for
    ip, Luhn for card, a count of digits for phone, mod 97 for iban, unissued numbers for ssn. Score: the kind's
    base plus 0.2 for a checksum plus 0.3 for a context word among the 40 characters on either side. Spans of the
    base kinds stay whatever their score; the others are reported from 0.5 on.

    Defined cases: a null text is empty; an empty table gives an empty table; other columns pass untouched; rows
    that repeat are answered each. A map-side projection: no shuffle, and nothing depends on other rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = []
    for rank, (kind, expression, _, _) in enumerate(KINDS):
        kept = F.filter(_found(kind, expression, text), _check(kind))
        parts.append(F.transform(kept, _ranked(rank)))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # Only texts with a span are cut into blocks. Structs sort field by field: by start, then in the order of the kinds.
    found = F.concat(*parts)
    scored = let(found, lambda f: F.when(F.size(f) > 0, let(blocks, lambda b: F.transform(F.array_sort(f), _score(b)))))
    reported = F.filter(scored, lambda x: (x["rank"] < len(BASE)) | (x["score"] >= REPORT))
    return docs.withColumn(out_col, F.coalesce(reported, F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,hit:string,score:double>>")))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
