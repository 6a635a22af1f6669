"""Text functions as column expressions. ``\\w`` is spelled as letters, numbers and underscore of all scripts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACES = r"[ \t\n\x0b\f\r]+"
WORD = r"[\p{L}\p{N}_]+"
#: Function words that mark English and German text.
#: German function words by which a text is suspected.
GERMAN = tuple("und nicht ich der die das ist wie sie mir ein eine auf zu mit vergiss alle bitte".split())


def normalise(t: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(t), SPACES, " "))


def normalise_loose(t: Column) -> Column:
    """Lower case, everything but letters, numbers and underscore as one space."""
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]+", " "))


def normalise_long(t: Column, least: int = 20) -> Column:
    """The normal form where it has at least ``least`` characters, else null: short texts match nothing."""
    n = normalise(t)
    return F.when(F.length(n) >= least, n)


def words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))


#: Bytes of texts whose words are Python objects at once; a longer text stands alone.
PYTHON_BYTES = 1 << 20


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to ``most`` or little more."""
    ends, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


@F.arrow_udf(ArrayType(StringType()))
def _nfkc_words(t: pa.Array) -> pa.Array:
    def one(x: str | None):
        if x is None:
            return None
        x = unicodedata.normalize("NFKC", x).lower().replace("'", "").replace("’", "")
        return "".join(c if c.isalnum() or c == "_" else " " for c in x).split()

    sizes = pa.compute.fill_null(pa.compute.binary_length(t), 0).to_numpy(zero_copy_only=False)
    made = [pa.array([one(x) for x in t.slice(lo, hi - lo).to_pylist()], pa.list_(pa.string())) for lo, hi in _parts(sizes, PYTHON_BYTES)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))


def compatible_words(t: Column) -> Column:
    """Words of the compatibility-composed text, apostrophes dropped. Spark has no NFKC: one vectorised function."""
    return _nfkc_words(t)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(w: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` words; a shorter text is one shingle, an empty one has none."""

    def cut(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return let(w, cut)


def field_shingles(fields: list[Column], n: int = 5) -> Column:
    """Distinct shingles of several fields, none across a border."""
    return F.array_distinct(F.flatten(F.array(*[shingles(words(F.coalesce(f, F.lit(""))), n) for f in fields])))


def ascii_letter_share(t: Column) -> Column:
    """Share of ASCII letters among all characters that are no white space."""
    return F.try_divide(F.length(F.regexp_replace(t, r"[^A-Za-z]", "")), F.length(F.regexp_replace(t, r"[ \t\n\x0b\f\r]", "")))


def hits(t: Column, lexicon: tuple[str, ...]) -> Column:
    """How many words of a text are in a small lexicon."""
    return F.size(F.filter(words(t), lambda w: w.isin(*lexicon)))


#: Common function words of English and of six other languages.
COMMON_ENGLISH = "the and is not what how with for you are all please of to in a your me i it this that be can will my on as do".split()
COMMON_OTHER = {
    "de": "und der die das ist nicht ich wie was mit für auf ein eine sie du bitte vergiss alle sind wir zu den dem des auch über kann".split(),
    "es": "el la los las que por para una yo tu tus dices todo como pero mis sigue y de del sus".split(),
    "fr": "le les des une est pas vous pour dans avec ceci toutes et je sans ta tes sur cette comme".split(),
    "id": "yang anda saya dengan untuk dalam ini itu sebagai tulis bahasa artikel dari akan atau tidak bisa minimal kata".split(),
    "pt": "você não uma para com por como mais seu sua isso ou ser suas diga-me".split(),
    "it": "il di che è non sono una della le tue tuo questa dietro".split(),
}
EDGES = ".,!?;:\"'()[]{}¿¡"


def is_english(t: Column) -> Column:
    """Whether a text reads as English: mostly ASCII among its letters, and no other language's function words prevail.
    Texts with look-alike letters pass by two English function words and six ASCII letters in ten."""
    share = F.length(F.regexp_replace(t, "[^A-Za-z]", "")) / F.length(F.regexp_replace(t, r"[^\p{L}]", ""))

    def judged(w: Column) -> Column:
        among = lambda known: F.size(F.filter(w, lambda x: x.isin(*known)))
        en, others = among(COMMON_ENGLISH), [among(v) for v in COMMON_OTHER.values()]
        foreign = reduce(lambda a, b: a | b, [((o >= 2) & (o > en)) | ((o >= 1) & (en == 0)) for o in others])
        odd = (en == 0) & (F.size(w) >= 4) & (share < 0.98)
        return ~foreign & ~odd & ((share >= 0.9) | ((share >= 0.6) & (en >= 2)))

    tokens = F.filter(F.split(t, SPACES), lambda x: x != "")
    return F.when(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) == 0, False).otherwise(let(F.transform(tokens, lambda x: F.lower(F.btrim(x, F.lit(EDGES)))), judged))


def lexicon_terms(t: Column, lexicon: tuple[str, ...]) -> Column:
    """The distinct terms of a lexicon that a text holds, in order."""
    return F.array_sort(F.array_distinct(F.filter(words(t), lambda w: w.isin(*lexicon))))


def contains_phrase(t: Column, phrase: str) -> Column:
    """Whether a text holds a phrase as whole words, whatever its case."""
    return F.contains(F.concat(F.lit(" "), normalise_loose(t), F.lit(" ")), F.lit(f" {phrase.lower()} "))


def bucket_of(t: Column, mild: tuple[str, ...], strong: tuple[str, ...]) -> Column:
    n = words(t)
    return F.when(F.exists(n, lambda w: w.isin(*strong)), "strong").when(F.exists(n, lambda w: w.isin(*mild)), "mild").otherwise("clean")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
STREET = r"[0-9]+ [A-Z][a-z]+ (Street|Road|Avenue|Lane)"


def entity_flags(t: Column) -> Column:
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in (("email", EMAIL), ("phone", PHONE), ("ssn", SSN), ("ip", IPV4), ("street", STREET))]))


def ip_values(t: Column) -> Column:
    """Distinct IPv4 values with parts of at most 255, in order."""
    found = F.regexp_extract_all(t, F.lit(IPV4), F.lit(0))
    fine = F.filter(found, lambda x: F.forall(F.split(x, r"\."), lambda p: p.cast("int") <= 255))
    return F.array_sort(F.array_distinct(fine))


def mask_email(t: Column) -> Column:
    return F.regexp_replace(t, EMAIL, "<email>")


def template_key(t: Column) -> Column:
    """A hash of a text with months, numbers and mail addresses masked."""
    t = mask_email(F.lower(t))
    t = F.regexp_replace(t, r"(january|february|march|april|may|june|july|august|september|october|november|december)", "<month>")
    return F.sha1(F.regexp_replace(F.regexp_replace(t, r"[0-9]+", "<n>"), SPACES, " "))


def format_flags(t: Column) -> Column:
    return F.struct(
        t.contains("\n").alias("multiline"), t.rlike(r"[?]").alias("question"), t.rlike(r"https?://").alias("url"), t.rlike(r"```|<[a-z]+>").alias("markup"),
        (F.regexp_count(t, F.lit(r"[A-Z]")) * 2 > F.regexp_count(t, F.lit(r"[A-Za-z]"))).alias("shouting"),
    )


def log2_bin(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(F.lit(1), n).cast("double"))).cast("int")


def edge_bin(n: Column, edges: tuple[int, ...]) -> Column:
    """How many edges a value reaches."""
    return sum(((n >= e).cast("int") for e in edges), start=F.lit(0))


def sentences(t: Column) -> Column:
    """Runs up to a full stop, exclamation or question mark, or the end of a line."""
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def probe(t: Column, n: int = 6) -> Column:
    """``n`` words from the middle of a text; all of a shorter one."""
    middle = lambda w: F.slice(w, F.greatest(F.lit(1), F.floor((F.size(w) - n) / 2).cast("int") + 1), n)
    return F.array_join(let(words(t), middle), " ")


def quote_windows(t: Column, width: int = 50, step: int = 25) -> Column:
    """Windows of a text every ``step`` characters, and the last one."""
    last = F.greatest(F.lit(1), F.length(t) - width + 1)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last)))
    return F.when(F.length(t) > 0, F.transform(starts, lambda i: F.substring(t, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def redact(t: Column, keep: Column) -> Column:
    """(text, digest): the text only where it may stay, its digest always."""
    return F.struct(F.when(keep, t).alias("text"), F.sha2(t, 256).alias("digest"))


def restore(digest: Column, candidate: Column) -> Column:
    """A text for a digest, accepted only if it has that digest."""
    return F.when(F.sha2(candidate, 256) == digest, candidate)


def leet(t: Column) -> Column:
    return F.translate(t, "aeiost", "431057")


def zero_width(t: Column) -> Column:
    """A zero-width space after every letter a."""
    return F.replace(t, F.lit("a"), F.lit("a​"))


def base64_text(t: Column) -> Column:
    return F.base64(F.encode(t, "UTF-8"))


def token_estimate(t: Column) -> Column:
    return F.ceil(F.length(t) / 3.5).cast("int")


def scrub(message: Column, text: Column, n: int = 8) -> Column:
    """An error message, replaced if it repeats ``n`` words of a text in a row."""
    return F.when(F.arrays_overlap(shingles(words(message), n), shingles(words(text), n)), F.lit("<scrubbed>")).otherwise(message)


def unit_interval(digest: Column) -> Column:
    """A number in [0, 1) out of the first 13 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def salted(key: Column, salt: str) -> Column:
    """HMAC-SHA256 of a key under a salt of at most 64 bytes, composed of two hashes."""
    padded = salt.encode().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(key, "UTF-8")), 256))), 256)


def fnv1a(t: Column) -> Column:
    """32-bit FNV-1a of an ASCII key, as a fold."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619) % 4294967296
    return F.aggregate(F.split(t, ""), F.lit(2166136261).cast("long"), step)
