"""Column functions over text: normalisation, tokens, phrases, snippets, chunks, fingerprints."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no meaning in a research goal.
STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "with", "year")
#: White space: what Unicode and ASCII control characters separate words.
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas (which would compute it each time)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space (Unicode's too) as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f" {SPACE}+|[{SPACE}&&[^ ]]{SPACE}*", " "))  # a single space is no match, and stays


def strip(c: Column) -> Column:
    """c without white space (Unicode's too) at its ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_title(c: Column, unicode: str = "nfkc") -> Column:
    """Compatibility forms and case folded, everything but letters, digits and underscores a space, collapsed; 'lower' only
    lowers case.

    ASCII texts, for which both are the same, are not sent to the worker that folds.
    """
    ascii_only = c.rlike(r"^\p{ASCII}*$")
    folded = F.coalesce(nfkc_casefold(F.when(~ascii_only, c)), F.lower(c)) if unicode == "nfkc" else F.lower(c)
    return collapse(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", " "))


def nfkc_casefold(c: Column) -> Column:
    """NFKC and case folding, which Spark has no function for, as an Arrow-backed UDF."""
    @F.pandas_udf(T.StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return fold(c)


def normalize_doi(c: Column) -> Column:
    """Trimmed, lower, without resolver prefix and final dots; empty is null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https://doi\.org/|http://doi\.org/|doi:)", "")
    return F.nullif(F.regexp_replace(bare, r"[ .]+$", ""), F.lit(""))


def bare_doi(c: Column) -> Column:
    """A DOI as it was written, without white space around it and without a resolver's address or prefix."""
    return F.regexp_replace(strip(c), rf"(?i)^(https?://doi\.org/|doi:){SPACE}*", "")


def reconstruct_abstract(index: Column) -> Column:
    """Text from a map of word to positions; null where there is none."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def inverted_index(words: Column) -> Column:
    """A map of each word of an array to its places, which reconstruct_abstract reads; null where there are no words.

    Made within the row: words and places are sorted once and cut where the word changes, so nothing is shuffled.
    """
    places = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def cut(p: Column) -> Column:
        changes = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.coalesce(F.get(p, i - 1)["w"] != F.get(p, i)["w"], F.lit(True)))
        run = lambda starts: F.transform(starts, lambda a, k: F.struct(
            F.get(p, a)["w"].alias("word"), F.transform(F.slice(p, a + 1, F.coalesce(F.get(starts, k + 1), F.size(p)) - a), lambda x: x["p"]).alias("places"),
        ))
        return F.map_from_entries(bind(changes, run))

    return F.when(F.size(words) > 0, bind(places, cut))


def tokens(c: Column) -> Column:
    """Distinct lower-case ASCII tokens without stop words, in order of first use; null text has none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z0-9][a-zA-Z0-9+-]*"), 0), F.lower)
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def tokens_among(c: Column, terms: list[str]) -> Column:
    """The tokens of c that are among the terms (tokens themselves), lower case, in order, repeats kept.

    One search for the terms as whole tokens, which leaves all others of a long text unbuilt.
    """
    if not terms:
        return F.array().cast("array<string>")
    longest = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i)(?<![a-zA-Z0-9+-])[+-]*({longest})(?![a-zA-Z0-9+-])"), 1)
    return F.transform(found, F.lower)


def plain_tokens(text: str) -> list[str]:
    """tokens() of a text at hand."""
    found = [t.lower() for t in re.findall("[a-zA-Z0-9][a-zA-Z0-9+-]*", text)]
    return [t for t in dict.fromkeys(found) if t not in STOPWORDS]


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def has_phrase(text: Column, term: Column) -> Column:
    """Whether normalised text holds the normalised term as whole words."""
    return F.contains(padded(text), padded(term))


def relevant_snippet(text: Column, terms: list[str], limit: int) -> Column:
    """At most limit characters, starting limit // 3 before the first term that occurs."""
    spots = F.filter(F.array(*[F.instr(F.lower(text), t) - 1 for t in terms] or [F.lit(-1)]), lambda p: p >= 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(spots), F.lit(0)) - limit // 3)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.substr(text, start + 1, F.lit(limit)))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, nulls written, so that no two different rows have one text."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}).cast("binary"), 256)


#: Marks that a chunk may end with; it ends after the first character of one.
BOUNDARIES = ("\n", "。", ". ", "；", "; ")
_MARKS = re.compile("|".join(map(re.escape, BOUNDARIES)))


def chunk_spans(text: str, size: int = 950, overlap: int = 140) -> list[tuple[int, int, str]]:
    """(start, end, excerpt) of the chunks of a text, without white space at their ends.

    A chunk has at most `size` characters of the text between its outer white space. It ends after the last mark that lies
    whole in its second half, if there is one, and the next begins `overlap` characters before that end. All marks are
    found in one search, so a text costs time in proportion to its length.
    """
    body = text.rstrip()
    at, n = len(body) - len(body.lstrip()), len(body)
    marks = [(m.start(), m.end()) for m in _MARKS.finditer(body)] if n - at > size else []
    spans, i = [], 0
    while at < n:
        end = min(n, at + size)
        if end < n:
            while i < len(marks) and marks[i][1] <= end:
                i += 1
            if i and marks[i - 1][0] >= at + size // 2:
                end = marks[i - 1][0] + 1
        piece = body[at:end]
        kept = piece.strip()
        if kept:
            first = at + len(piece) - len(piece.lstrip())
            spans.append((first, first + len(kept), kept))
        at = n if end == n else max(at + 1, end - overlap)
    return spans


def chunk_text(text: Column, size: int = 950, overlap: int = 140) -> Column:
    """array<struct<start, end, excerpt>> of a text's chunks, over Arrow batches; null and blank texts have none."""

    @F.pandas_udf("array<struct<start:int,end:int,excerpt:string>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: [dict(zip(("start", "end", "excerpt"), c, strict=True)) for c in chunk_spans(x or "", size, overlap)])

    return run(text)


def schema_of(df, names) -> str:
    """Some columns of df as the beginning of a schema in SQL form."""
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def distinct_ci(arr: Column) -> Column:
    """Trimmed, case-insensitive distinct in first-seen order; blanks go."""
    trimmed = F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: F.char_length(x) > 0)
    lows = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)


def ordered_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


def set_ops(a: Column, b: Column) -> Column:
    """struct(both, only_a, only_b, a_in_b) of two arrays as sets; a null array is an empty set."""
    a, b = F.coalesce(a, F.array()), F.coalesce(b, F.array())
    return F.struct(
        F.array_intersect(a, b).alias("both"), F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"), (F.size(F.array_except(a, b)) == 0).alias("a_in_b")
    )


def to_payload(*cols: Column) -> Column:
    """Columns as one JSON text, null fields included."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def from_payload(text: Column, schema: str) -> Column:
    """The struct of a JSON text; null where it cannot be read."""
    return F.from_json(text, schema)


#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def json_candidates(text: Column) -> Column:
    """Texts that may be the JSON of a model's answer: without the lines of a code fence, and from first to last brace."""
    whole = strip(text)
    lines = F.split(whole, LINE_ENDS)
    inner = strip(F.array_join(F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 2)), "\n"))
    plain = F.when(whole.rlike(r"(?s)^```") & whole.rlike(r"```$"), inner).otherwise(whole)
    found = lambda x: F.array_distinct(F.array_compact(F.array(x, F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit("")))))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(bind(plain, found))


def stops_early(candidate: str) -> bool:
    """Whether a text is JSON that was cut off: parsing fails in an open string, or at the text's last character or beyond it.

    What is malformed further ahead, or nested too deep to be read, was not cut.
    """
    try:
        json.loads(candidate)
    except json.JSONDecodeError as e:
        return e.msg.startswith("Unterminated string") or e.pos >= len(candidate.rstrip()) - 1
    except (RecursionError, ValueError):
        return False
    return False


def is_truncated(text: Column) -> Column:
    """Whether any JSON candidate of an answer was cut off; by place of the error, which no built-in function tells. Null has none."""

    @F.pandas_udf(T.BooleanType())
    def run(candidates: pd.Series) -> pd.Series:
        return candidates.map(lambda texts: any(stops_early(t) for t in texts) if texts is not None else False)

    return run(json_candidates(text))


def mention_snippet(text: Column, start: Column) -> Column:
    """160 characters before and 240 after a place (from 0), collapsed, at most 400."""
    low = F.greatest(F.lit(0), start - 160)
    return F.substring(collapse(F.substr(text, low + 1, start + 240 - low)), 1, 400)
