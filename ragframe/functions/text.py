"""Text, list, map and JSON functions: JVM-side expressions, but for the last step of the hashing embedder."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Lines of the page sources that start with one of these are dropped.
DROPPED_PREFIXES = ("----", "language: ", "lines: ", ":class: ", ":align: ", ":alt: ", ":scale: ", ":gutter: ", ":columns: ", ":widths: ", ":width: ", ":delim: ", "%")

# Rewrites of the page sources' markup, in order; group references are written \1.
REWRITES = (
    (r"\{ref\}`(.+?)>`", r"\1>"),
    (r"\{ref\}`(.+?)`", r"\1"),
    (r"\{doc\}`(.+?)>`", r"\1>"),
    (r"\{eq\}`(.+?)>`", r" (see equation \1)"),
    (r"\{cite\}`(.+?)`", r"[citation: \1]"),
    (r"\{superscript\}`(.+?)`", r"^\1"),
    (r"`{4}\{tab-item\} (.+)\n`{3}\{csv-table\}\n", "Table of \\1 (separator='$')\n```\nName $ description $ reference\n"),
    (r"`{4}\{tab-item\} (.+)\n", "\\1\n"),
    (r"\{(image|figure)\} (.+)", "\nFigure: \\2"),
    (r"\{(admonition|tip|warning|note|important)\}", "\nNOTE: "),
    (r"\{(code|code-block|download|grid-item-card|grid|tab-set|csv-table)\}", ""),
    (r"(schema:|units:|<i>|</i>|&emsp;|`{5}|`{4})", ""),
    (r"(`{4})", "\n"),
)
#: One of these stands in whatever a rewrite, in the same order, finds.
MARKS = (
    ("{ref}`",), ("{ref}`",), ("{doc}`",), ("{eq}`",), ("{cite}`",), ("{superscript}`",), ("{tab-item} ",), ("{tab-item} ",), ("{image} ", "{figure} "),
    ("{admonition}", "{tip}", "{warning}", "{note}", "{important}"), ("{code", "{download}", "{grid", "{tab-set}", "{csv-table}"), ("schema:", "units:", "i>", "&emsp;", "````"), ("````",),
)

# Labels of a question.
QUERY_TYPES = ("undefined", "general_question", "domain_question", "domain_code_generation")
NEXT_STEPS = ("continue", "retrieve_more_info", "modify_query", "rewrite_answer", "undefined")
TOOL_ACTIONS = ("tool_call", "update_code", "final_answer")

SPACE = r"[ \t\n\x0B\f\r]"
TRIM_CHARS = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def strip_thoughts(c: Column, end: str = "</think>") -> Column:
    """The answer part of a model's output: what stands between the first and a second end mark, stripped; all of it without a mark."""
    return strip(F.when(F.contains(c, F.lit(end)), F.split_part(c, F.lit(end), F.lit(2))).otherwise(c))


def thought(c: Column, end: str = "</think>") -> Column:
    """The part before the first end mark; null without one."""
    return F.when(F.contains(c, F.lit(end)), strip(F.split_part(c, F.lit(end), F.lit(1))))


def parse_json(c: Column, schema: str, defaults: dict[str, object]) -> Column:
    """A typed record of the model's output; malformed or missing parts take their defaults, so that no field is null."""
    got = F.from_json(strip_thoughts(c), schema)
    return F.struct(*[F.coalesce(got[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def enum_check(c: Column, allowed: tuple[str, ...], default: str = "undefined") -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def coerce_output(c: Column, key: str = "query_type", allowed: tuple[str, ...] = QUERY_TYPES) -> Column:
    """A label from a record with that key, from a bare label, else `undefined`."""
    plain = strip_thoughts(c)
    return enum_check(F.coalesce(F.get_json_object(plain, f"$.{key}"), plain), allowed)


def contains_ci(c: Column, word: str) -> Column:
    return F.contains(F.lower(c), F.lit(word.lower()))


def starts_with_ci(c: Column, prefix: str) -> Column:
    return F.startswith(F.lower(c), F.lit(prefix.lower()))


def split_fixed(c: Column, sep: str = ":", parts: int = 3) -> Column:
    """Exactly so many parts, else null (for a quarantine)."""
    got = F.split(c, F.lit(f"\\Q{sep}\\E"), -1)
    return F.when(F.size(got) == parts, got)


def default_if_null(c: Column, default: str) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def doc_summary(c: Column) -> Column:
    """A description without its parameter list."""
    return strip(F.substring_index(c, ":param", 1))


def strip_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def escape_braces(c: Column) -> Column:
    """Braces doubled, for templates."""
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def last_n(c: Column, n: int) -> Column:
    """The last n elements of a list (all, if fewer)."""
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 1), F.lit(n))


def map_update(a: Column, b: Column) -> Column:
    """a with b's entries, b winning; independent of the session's key policy."""
    rest = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(rest, b)


def normalize_model_name(c: Column) -> Column:
    """Model name without provider, routing suffix and leading organisation."""
    hosted = F.replace(F.replace(F.replace(c, F.lit("huggingface:"), F.lit("")), F.lit(":cheapest"), F.lit("")), F.lit(":fastest"), F.lit(""))
    parts = F.split(hosted, "/", -1)
    return (
        F.when(starts_with_ci(c, "huggingface:"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ""))
        .when(starts_with_ci(c, "ollama:"), F.replace(c, F.lit("ollama:"), F.lit("")))
        .otherwise(c)
    )


def store_path(store: Column, model: Column) -> Column:
    """Place of a store's collection for a model."""
    return F.concat(store, F.lit("_"), F.replace(model, F.lit(":"), F.lit("_")), F.lit(".db"))


def dropped_line(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(line, F.lit(p)) for p in DROPPED_PREFIXES])


def _java(replacement: str) -> str:
    out = replacement.replace("$", r"\$")
    for n in "123":
        out = out.replace(f"\\{n}", f"${n}")
    return out


def regex_rewrites(c: Column) -> Column:
    """All rewrites in order; a pattern goes only over texts with its mark, as most have few of them."""

    def one(t: Column, pattern: str, to: str, marks: tuple[str, ...]) -> Column:
        found = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks])
        # By way of an array, so that the text so far is computed once.
        return F.transform(F.array(t), lambda x: F.when(found(x), F.regexp_replace(x, "(?m)" + pattern, _java(to))).otherwise(x))[0]

    return reduce(lambda t, x: one(t, *x[0], x[1]), zip(REWRITES, MARKS, strict=True), c)


def name_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def tokens(c: Column) -> Column:
    """Lower-cased words of letters, digits and underscores beyond ASCII too."""
    return F.filter(F.split(F.lower(c), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda x: x != "")


def bucket(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")


_SOLID = np.zeros(256, bool)  # the bytes of a token, as `tokens` has them once the text is lower-cased
_SOLID[0x30:0x3A] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True
#: Bytes of text that the embedder takes apart at a time, if no single text is longer.
PART = 1 << 22


def _coded_words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of lower-case texts that lie between these bounds of the data; the words of all in order, as places among them; how many a text has."""
    solid = _SOLID[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    some = np.diff(bounds) > 0
    first, last = bounds[:-1][some], bounds[1:][some] - 1
    begins[first], ends[last] = solid[first], solid[last]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - begins)))
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.diff(np.searchsorted(begins, bounds))


def _unit_counts(dim: int, packed: bool = False):
    """Lower-case texts to unit vectors of their tokens' counts by bucket, some at a time; each distinct token of these is hashed once. packed: each vector's doubles as bytes."""

    @F.arrow_udf("binary" if packed else "array<double>")
    def unit_counts(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        counts, at = np.zeros((len(texts), dim)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART, side="right")) - 1)
            distinct, codes, sizes = _coded_words(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            raw, cuts = bytes(distinct.buffers()[2] or b""), np.frombuffer(distinct.buffers()[1] or b"", np.int64)[: len(distinct) + 1].tolist()
            of = np.frombuffer(b"".join([hashlib.md5(raw[a:b]).digest()[:4] for a, b in zip(cuts, cuts[1:])]), ">u4").astype(np.int64) % dim
            flat = np.repeat(np.arange(to - at), sizes) * dim + of[codes]
            counts[at:to] = np.bincount(flat, minlength=(to - at) * dim).reshape(-1, dim)
            at = to
        norm = np.sqrt((counts * counts).sum(axis=1))
        fine = norm > 0
        values = counts[fine] / norm[fine][:, None]
        offsets = np.concatenate(([0], np.cumsum(np.where(fine, dim, 0))))
        if packed:
            return pa.Array.from_buffers(pa.binary(), len(texts), [pa.array(fine).buffers()[1], pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(values)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=pa.array(~fine))

    return unit_counts


def hashed_vector(c: Column, dim: int, packed: bool = False) -> Column:
    """Feature-hashing embedding (Weinberger et al. 2009): token counts by bucket, as a unit vector; null without a token.

    Texts are lower-cased in the JVM and go to Python whole in Arrow batches; their tokens are found (as `tokens` does), hashed
    (as `bucket` does) and counted there.
    """
    return _unit_counts(dim, packed)(F.lower(c))
