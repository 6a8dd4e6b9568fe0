"""Parsing, rendering, differences and validation of reports, as column expressions over one parsed struct.

A report is ``FINDINGS:`` with lines ``KEY: value`` and then ``IMPRESSION:``. Parsed, it is
``struct<fields: array<struct<key, value>>, impression>``, fields in order and repeats kept. Parse once and pass the struct on: common
subexpressions inside lambdas aren't shared by the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .binding import bound
from .text import capitalize, measurements, sentences, strip, text_or_empty


def _sections(text: Column) -> Column:
    return F.split(text_or_empty(text), r"(?i)\n(?=IMPRESSION:)", -1)


def _body(sections: Column) -> Column:
    """What stands before the impression, without the leading title."""
    return strip(F.regexp_replace(F.get(sections, F.lit(0)), rf"(?i)^FINDINGS:{C.WS}*", ""))


def body(text: Column) -> Column:
    return _body(_sections(text))


def _keys(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit("(?d)" + C.FIELD), 1), strip)


def keys(text: Column) -> Column:
    return _keys(body(text))


def parse(text: Column) -> Column:
    """Sections, body and values are found once each."""

    def fields(b: Column) -> Column:
        values = bound(F.split(b, "(?d)" + C.FIELD, -1), lambda v: F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))))
        return F.zip_with(_keys(b), values, lambda k, v: F.struct(k.alias("key"), strip(v).alias("value")))

    def whole(s: Column) -> Column:
        impression = strip(F.regexp_replace(F.coalesce(F.get(s, F.lit(1)), F.lit("")), rf"(?i)^IMPRESSION:{C.WS}*", ""))
        return F.struct(bound(_body(s), fields).alias("fields"), impression.alias("impression"))

    return bound(_sections(text), whole)


def field_keys(fields: Column) -> Column:
    return F.transform(fields, lambda f: f.key)


def last_value(fields: Column, key: Column) -> Column:
    """The value of the last field of that key, or null."""
    return F.try_element_at(F.filter(fields, lambda f: f.key == key), F.lit(-1)).value


def as_dict(fields: Column) -> Column:
    """Repeated keys merged: the place of the first, the value of the last."""

    def merged(f: Column, ks: Column) -> Column:
        first = F.filter(f, lambda x, i: F.array_position(ks, x.key) == i + 1)
        return F.transform(first, lambda x: F.struct(x.key.alias("key"), last_value(f, x.key).alias("value")))

    return bound(fields, lambda f: bound(field_keys(f), lambda ks: merged(f, ks)))


def signature(fields: Column) -> Column:
    """Upper-cased keys in order, repeats kept."""
    return F.transform(fields, lambda f: strip(F.upper(f.key)))


def changed_fields(template: Column, report: Column) -> Column:
    """Fields of a parsed report whose value differs from the parsed template's, which counts as empty where it lacks the key."""
    return bound(
        F.struct(template.fields.alias("t"), report.fields.alias("r")),
        lambda x: as_dict(F.filter(x.r, lambda f: f.value != F.coalesce(last_value(x.t, f.key), F.lit("")))),
    )


def render(template: Column, updates: Column, impression: Column) -> Column:
    """The report of a parsed template with updates (``array<struct<key, value>>``) applied.

    The first update of a field's key, in any case, replaces its value unless it is empty; updates of other keys follow at the end.
    A blank impression keeps the template's.
    """
    def folded(k: Column) -> Column:
        return F.upper(strip(k))

    def line(f: Column, ups: Column) -> Column:
        u = F.get(F.filter(ups, lambda x: folded(x.key) == folded(f.key)), F.lit(0))
        use = F.coalesce((u.key != "") & (u.value != ""), F.lit(False))
        return F.concat(f.key, F.lit(": "), F.when(use, strip(u.value)).otherwise(strip(f.value)))

    def extra(x: Column) -> Column:
        unknown = bound(F.transform(x.t.fields, lambda f: folded(f.key)), lambda ks: F.filter(x.u, lambda u: ~F.array_contains(ks, folded(u.key)) & F.coalesce(u.value != "", F.lit(False))))
        return F.transform(unknown, lambda u: F.concat(folded(u.key), F.lit(": "), strip(u.value)))

    def whole(x: Column) -> Column:
        lines = F.concat(F.transform(x.t.fields, lambda f: line(f, x.u)), extra(x))
        said = strip(F.coalesce(x.i, F.lit("")))
        return F.concat(F.lit("FINDINGS:\n"), F.array_join(lines, "\n"), F.lit("\n\nIMPRESSION:\n"), F.when(said != "", said).otherwise(strip(x.t.impression)))

    return bound(F.struct(template.alias("t"), updates.alias("u"), impression.alias("i")), whole)


def structure_issues(report: Column, template: Column) -> Column:
    """What is wrong with a report's structure: titles missing, or keys of the template (sorted) missing."""
    text = text_or_empty(report)
    missing = F.array_sort(F.array_except(keys(template), keys(report)))
    issues = F.array_compact(
        F.array(
            F.when(~text.rlike(r"(?imd)^FINDINGS:"), F.lit("Missing top-level 'FINDINGS:' section header.")),
            F.when(~text.rlike(r"(?i)IMPRESSION:"), F.lit("Missing top-level 'IMPRESSION:' section header.")),
            F.when(F.size(missing) > 0, F.concat(F.lit("Missing template fields in report: "), F.array_join(missing, ", "))),
        )
    )
    return F.when(strip(text) == "", F.array(F.lit("Report text is empty."))).otherwise(issues)


def fidelity_warnings(dictation: Column, report: Column) -> Column:
    """Sides and measurements that are dictated and aren't in the report, as substrings; a repeated measurement warns each time."""
    said, written = F.lower(text_or_empty(dictation)), F.lower(text_or_empty(report))
    sides = [F.when(said.contains(s) & ~written.contains(s), F.lit(f"Laterality '{s}' present in dictation but missing in report.")) for s in ("right", "left")]
    lost = bound(written, lambda w: F.filter(measurements(dictation), lambda m: ~F.contains(w, m)))
    return F.concat(F.array_compact(F.array(*sides)), F.transform(lost, lambda m: F.concat(F.lit("Measurement '"), m, F.lit("' from dictation not found in report."))))


def routed(fields: Column, impression: Column, dictation: Column) -> Column:
    """``struct<updates, impression>``: each sentence goes to the first field of which a word of over three letters is in it.

    Sentences without such a field go to the first field with OTHER in its key, if there is one; the last sentence of a field counts. The impression is
    all sentences; a dictation that says all is normal changes nothing.
    """
    def target(s: Column, fs: Column) -> Column:
        hit = bound(F.lower(s), lambda low: F.get(F.filter(fs, lambda f: F.exists(f.words, lambda w: F.contains(low, w))), F.lit(0)))
        other = F.get(F.filter(fs, lambda f: f.other), F.lit(0))
        return bound(hit.key, lambda k: F.when(k.isNotNull(), F.struct(k.alias("key"), capitalize(s).alias("value"))).otherwise(F.struct(other.key.alias("key"), s.alias("value"))))

    def named(f: Column) -> Column:
        words = F.filter(F.split(F.lower(f.key), f"{C.WS}+"), lambda w: F.length(w) > 3)
        return F.struct(f.key.alias("key"), words.alias("words"), F.upper(f.key).contains("OTHER").alias("other"))

    def whole(x: Column) -> Column:
        normal = (x.said == "") | F.lower(x.said).isin(C.NORMAL_DICTATIONS)
        parts = F.when(normal, F.slice(x.parts, 1, 0)).otherwise(x.parts)
        made = bound(F.transform(x.f, named), lambda fs: F.transform(parts, lambda s: target(s, fs)))
        updates = as_dict(F.filter(made, lambda u: u.key.isNotNull()))
        return F.struct(updates.alias("updates"), F.when(F.size(parts) == 0, x.i).otherwise(F.array_join(parts, " ")).alias("impression"))

    said = strip(text_or_empty(dictation))
    return bound(F.struct(said.alias("said"), sentences(dictation).alias("parts"), fields.alias("f"), impression.alias("i")), whole)
