"""Licence scans with DataFrame functions alone: notices matched to templates, then inherited along directories.

Notices are taken from a text wherever they stand: of each sentence of a line with a cue word (``CUES``) the stretch around it; with white space and marks of comments folded, of each
sentence with one a short and a longer window from there on, across the ends of lines and sentences; the opening of the text, the block of comments that it begins with, and all of it if it is short. A notice's sparse TF-IDF vector is compared by
cosine with that of each template (``notices``): lines, headers, licence texts or their openings; inverse document frequencies are those of the template list, and words no
template has count as the rarest. A file's own licence is that of its most similar notice, long templates counting for more (``evidence``), if the cosine is ``LEAST`` or more; a bare reservation of all rights counts only
where nothing else does, and a known SPDX identifier before all.

A file without one takes the licence of the nearest directory above it (its own first) that holds a licence file
with one. Directories meet their ancestors by an equality join on paths: each distinct directory is exploded into its ancestors,
at most as many as its path has parts, and only once however many files it holds.

Defined results: null and empty texts have no notices; a very long text is scanned whole, and its opening and header are windows more; null paths are files of the root; of several
licence files in a directory the most similar counts, then the first by path; of templates that rank alike the first in the list; repeated rows and rows without an id each get
their result; an empty table gives no rows; a caller's other columns are kept, whatever their names, but for those of the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from .common import hot_joined, spread, written
from .notices import SPDX, TEMPLATES

CUES = "licen[cs]|copyright|public domain|all rights reserved|creative commons|redistribution and use|permission is hereby granted|permission to use|free software|spdx"
#: Both engines' patterns: where sentences end within lines and in folded text; a sentence's stretch around a cue, and all of it from shortly before a cue.
LINE_ENDS, ENDS = r"[.!?]+[ \n]+|\n", r"[.!?]+ "
STRETCH = r"[^\n]{0,80}(?:" + CUES + r")[^\n]{0,100}"
REST = r"[^\n]{0,60}(?:" + CUES + r")[^\n]*"
#: Code points of the two windows, and sentences that they reach over at most.
SHORT, LONG, REACH = 170, 480, 12
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: White space and marks of comments; the lines of comments that a text begins with, or one block of them.
MARKS = r"[ \t\r\n\f*#/;%|<>!=-]+"
HEADER = r"^(?:[ \t\r\n]*/\*[^*]*(?:\*+[^*/][^*]*)*\*+/|(?:[ \t]*(?:#|//|;|%|--|\*|/\*|\.\.|rem |dnl )[^\n]*\n|[ \t\r]*\n)+)"
SPDX_ID = r"spdx-license-identifier:[ (]*([a-z0-9.+-]+)"
#: Code points of an opening, and of a header or a text that is compared whole.
OPENING, WHOLE = 1200, 6000
LEAST = 0.5


def weights() -> tuple[dict[str, list[float]], dict[str, float], float]:
    """For each word of the templates: idf times its weight in each (normalised) template, and its idf; the idf of other words."""
    bags = [Counter(re.findall(WORD, text)) for _, text in TEMPLATES]
    n = len(bags)
    df = Counter(w for bag in bags for w in bag)
    idf = {w: round(math.log((1 + n) / (1 + c)) + 1, 6) for w, c in sorted(df.items())}
    norms = [math.sqrt(sum((c * idf[w]) ** 2 for w, c in bag.items())) for bag in bags]
    return {w: [round(bag[w] * idf[w] ** 2 / norm, 6) for bag, norm in zip(bags, norms, strict=True)] for w in idf}, idf, round(math.log(1 + n) + 1, 6)


def evidence() -> list[float]:
    """What a cosine with each template is multiplied by to rank notices: the logarithm of the template's words, so that a whole text or header counts for more than its parts."""
    return [round(math.log(len(re.findall(WORD, text))), 6) for _, text in TEMPLATES]


def numbers(values) -> Column:
    """A literal array of numbers, made by one call."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def best_match(notice: Column) -> Column:
    """``struct(sure, rank, order, score)`` of the template that a lower-cased notice says most surely; ``order`` is the template's number, negative; null if no cosine is ``LEAST``."""
    by_word, idf, other = weights()
    words = F.regexp_extract_all(notice, F.lit(f"({WORD})"), 1)
    vocabulary, gains, rarity = F.split(F.lit(" ".join(by_word)), " "), numbers(x for v in by_word.values() for x in v), numbers(idf.values())
    k = len(TEMPLATES)

    def counted(ws: Column) -> Column:
        return F.transform(F.array_distinct(ws), lambda w: F.struct((F.size(ws) - F.size(F.array_remove(ws, w))).cast("double").alias("tf"), F.array_position(vocabulary, w).cast("int").alias("at")))

    def scored(terms: Column) -> Column:
        known = F.filter(terms, lambda t: t.at > 0)
        dots = F.aggregate(known, numbers([0.0] * k), lambda acc, t: F.zip_with(acc, F.slice(gains, (t.at - 1) * k + 1, k), lambda a, g: a + g * t.tf))
        squares = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.pow(t.tf * F.when(t.at > 0, F.element_at(rarity, t.at)).otherwise(F.lit(other)), F.lit(2.0)))
        return bound(F.sqrt(squares), lambda norm: F.transform(dots, lambda d: F.round(F.try_divide(d, norm), 6)))

    def ranked(score: Column, j: Column) -> Column:
        return F.when(score >= LEAST, F.struct((j < k - 1).alias("sure"), F.round(score * F.get(numbers(evidence()), j), 6).alias("rank"), (-j).alias("order"), score.alias("score")))

    return F.array_max(F.transform(bound(bound(words, counted), scored), ranked))


def folded(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, " ")


def notices(low: Column) -> Column:
    """All notices of a lower-cased text."""
    lines = F.transform(F.filter(F.split(low, LINE_ENDS), lambda x: x.rlike(CUES)), lambda x: F.regexp_extract(x, STRETCH, 0))

    def windows(parts: Column) -> Column:
        def wide(x: Column, i: Column) -> Column:
            return F.when(x.rlike(CUES), F.substring(F.concat_ws(". ", F.regexp_extract(x, REST, 0), F.array_join(F.slice(parts, i + 2, F.lit(REACH)), ". ")), 1, LONG))

        return bound(F.filter(F.transform(parts, wide), lambda x: x.isNotNull()), lambda found: F.concat(found, F.transform(found, lambda x: F.substring(x, 1, SHORT))))

    def folds(flat: Column) -> Column:
        opening, header = F.substring(flat, 1, OPENING), folded(F.regexp_extract(low, HEADER, 0))
        whole = F.when(opening.rlike(CUES), F.array(opening, F.substring(header, 1, WHOLE), F.when(F.length(flat) <= WHOLE, flat)))
        return F.concat(bound(F.split(flat, ENDS), windows), F.coalesce(F.array_compact(whole), F.array().cast("array<string>")))

    return F.concat(lines, bound(folded(low), folds))


def scan(files: DataFrame) -> DataFrame:
    """Adds ``own_license`` and ``own_score`` to ``path, text`` and whatever else there is; drops the text."""
    columns = [c for c in files.columns if c not in ("text", "own_license", "own_score")]
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.lower(F.col("text").cast("string")).alias("low"))
    cued = F.col("low").rlike(CUES)
    ids = F.split(F.lit(" ".join(SPDX)), " ")
    named = F.filter(F.regexp_extract_all("low", F.lit(SPDX_ID), 1), lambda x: F.array_contains(ids, x))
    known = F.get(F.split(F.lit(" ".join(SPDX.values())), " "), F.array_position(ids, F.get(named, F.lit(0))).cast("int") - 1)
    rows = rows.select("row", F.when(cued & F.col("low").contains("spdx"), known).alias("known"), F.when(cued, F.array_max(F.transform(notices(F.col("low")), best_match))).alias("best"))
    names = F.split(F.lit(" ".join(name for name, _ in TEMPLATES)), " ")
    own, score = F.coalesce("known", F.get(names, -F.col("best.order"))), F.when(F.col("known").isNotNull(), 1.0).otherwise(F.col("best.score"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns], own.alias("own_license"), score.alias("own_score"))


def directory(path: Column) -> Column:
    """All of a path before its last slash; the root is empty."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


RESULT = ("license", "origin", "inherited_from")


def inherit(scanned: DataFrame, license_file: Column) -> DataFrame:
    """Adds ``license``, its ``origin`` (own, inherited or none) and ``inherited_from``; ``license_file`` says which rows' licences hold for directories.

    Reads the table several times, so give it a written one.
    """
    columns = [c for c in scanned.columns if c not in RESULT]
    rows = scanned.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), license_file.alias("holds"), directory(F.col("path")).alias("dir"))
    own, path = F.col("row").getField("own_license"), F.col("row").getField("path")
    order = F.struct(-F.col("row").getField("own_score"), F.coalesce(path, F.lit("")), own)
    holding = written(rows.filter(F.col("holds") & own.isNotNull()).groupBy(F.col("dir").alias("above")).agg(F.min_by(own, order).alias("held")), "holding")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    lines = rows.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = hot_joined(lines, holding, "above").groupBy("dir").agg(F.max_by(F.struct("held", "above"), F.length("above")).alias("nearest"))
    out = hot_joined(rows, written(nearest.select("dir", "nearest.held", "nearest.above"), "nearest"), "dir", "left")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in columns], F.coalesce(own, "held").alias("license"),
        F.when(own.isNotNull(), "own").when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(own.isNull(), F.col("above")).alias("inherited_from"),
    )


#: The layout that the query gives documents: every 8th is a licence file, every 64th one of the directory above.
PATH = (
    "concat(coalesce(source, 'none'), '/g', cast({div4096} as {text}), "
    "case when doc_id % 64 = 0 then concat('/LICENSE-', cast(doc_id as {text})) else concat('/h', cast({div64} as {text}), case when doc_id % 8 = 0 then '/LICENSE-' else '/f' end, cast(doc_id as {text})) end)"
)


def of_documents(docs: DataFrame) -> DataFrame:
    """The scan over ``documents``, laid out in directories by source and id."""
    path = F.expr(PATH.format(div4096="doc_id div 4096", div64="doc_id div 64", text="string"))
    files = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").select("doc_id", path.alias("path"), "text")
    files = spread(files)
    scanned = written(scan(files), "scanned")
    return inherit(scanned, F.coalesce(F.col("path").contains("/LICENSE-"), F.lit(False))).select("doc_id", "path", "own_license", "own_score", "license", "origin", "inherited_from")


def sql() -> str:
    """DuckDB SQL for ``of_documents``."""
    by_word, idf, other = weights()
    gains = ", ".join(f"('{w}', {k}, {v!r}::DOUBLE)" for w, vs in by_word.items() for k, v in enumerate(vs) if v)
    rarity = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in idf.items())
    names = ", ".join(f"({k}, '{name}', {e!r}::DOUBLE)" for k, ((name, _), e) in enumerate(zip(TEMPLATES, evidence(), strict=True)))
    spdx, among = ", ".join(f"('{k}', '{v}')" for k, v in SPDX.items()), ", ".join(f"'{k}'" for k in SPDX)
    path = PATH.format(div4096="doc_id // 4096", div64="doc_id // 64", text="varchar")
    flat, header = f"regexp_replace(low, '{MARKS}', ' ', 'g')", f"regexp_replace(regexp_extract(low, '{HEADER}'), '{MARKS}', ' ', 'g')"
    return f"""
WITH gains(w, k, gain) AS (VALUES {gains}), rarity(w, idf) AS (VALUES {rarity}), names(k, name, evidence) AS (VALUES {names}), spdx(id, name) AS (VALUES {spdx}),
files AS (SELECT doc_id, {path} AS path, lower(text) AS low FROM documents),
cued AS (SELECT doc_id, low, {flat} AS flat, {header} AS header FROM files WHERE regexp_matches(low, '{CUES}')),
whole AS (SELECT doc_id, unnest([flat[1:{OPENING}], header[1:{WHOLE}], CASE WHEN length(flat) <= {WHOLE} THEN flat END]) AS notice FROM cued WHERE regexp_matches(flat[1:{OPENING}], '{CUES}')),
lines_of AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(low, '{LINE_ENDS}'), lambda x: regexp_matches(x, '{CUES}')), lambda x: regexp_extract(x, '{STRETCH}')) AS l FROM cued),
parts AS (SELECT doc_id, regexp_split_to_array(flat, '{ENDS}') AS p FROM cued),
wide AS (SELECT doc_id, unnest(list_filter(list_transform(p, lambda x, i: CASE WHEN regexp_matches(x, '{CUES}') THEN concat_ws('. ', regexp_extract(x, '{REST}'), array_to_string(p[i + 1:i + {REACH}], '. '))[1:{LONG}] END),
  lambda x: x IS NOT NULL)) AS notice FROM parts),
notices AS (SELECT doc_id, unnest(l) AS notice FROM lines_of UNION ALL SELECT * FROM wide UNION ALL SELECT doc_id, notice[1:{SHORT}] FROM wide UNION ALL SELECT * FROM whole),
numbered AS (SELECT doc_id, notice, row_number() OVER () AS nr FROM notices),
words AS (SELECT doc_id, nr, unnest(regexp_extract_all(notice, '{WORD}')) AS w FROM numbered),
bags AS (SELECT doc_id, nr, w, count(*) AS tf FROM words GROUP BY ALL),
norms AS (SELECT nr, sqrt(sum((tf * coalesce(idf, {other!r}::DOUBLE)) ** 2)) AS norm FROM bags LEFT JOIN rarity USING (w) GROUP BY nr),
dots AS (SELECT doc_id, nr, k, sum(tf * gain) AS dot FROM bags JOIN gains USING (w) GROUP BY ALL),
scores AS (SELECT doc_id, k, round(dot / norm, 6) AS score FROM dots JOIN norms USING (nr)),
said AS (SELECT doc_id, list_filter(regexp_extract_all(low, '{SPDX_ID}', 1), lambda x: x IN ({among}))[1] AS id FROM cued),
ranked AS (SELECT doc_id, k, score, (k < {len(TEMPLATES) - 1}, round(score * evidence, 6), -k, score) AS r FROM scores JOIN names USING (k) WHERE score >= {LEAST}),
own AS (SELECT doc_id, arg_max(k, r) AS k, arg_max(score, r) AS score FROM ranked GROUP BY doc_id),
scanned AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, coalesce(spdx.name, names.name) AS own_license, CASE WHEN spdx.name IS NULL THEN score ELSE 1 END AS own_score
  FROM files LEFT JOIN own USING (doc_id) LEFT JOIN names USING (k) LEFT JOIN said USING (doc_id) LEFT JOIN spdx USING (id)),
holding AS (SELECT dir AS above, arg_min(own_license, (-own_score, path)) AS held FROM scanned WHERE path LIKE '%/LICENSE-%' AND own_license IS NOT NULL GROUP BY dir),
lines AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:n], '/') AS above FROM (SELECT DISTINCT dir FROM scanned), range(0, 8) AS r(n) WHERE n <= len(string_split(dir, '/'))),
nearest AS (SELECT dir, arg_max(held, length(above)) AS held, arg_max(above, length(above)) AS above FROM lines JOIN holding USING (above) GROUP BY dir)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, held) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN held IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own_license IS NULL THEN above END AS inherited_from
FROM scanned LEFT JOIN nearest USING (dir)"""
