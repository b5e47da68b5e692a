"""Answer and option expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import fixed as V
from gradeloom.functions.text import bind, trim_all


def fold_labels(text: Column) -> Column:
    """Upper-case, half-width answer labels."""
    return F.translate(text, V.LABEL_FROM, V.LABEL_TO)


def label_array(text: Column) -> Column:
    """Distinct labels A-G in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(fold_labels(text), F.lit("[A-G]"), F.lit(0)))


def clean_answer(answer: Column) -> Column:
    """Upper-cased distinct answer labels (question normalisation)."""
    return F.array_distinct(F.transform(F.coalesce(answer, F.array().cast("array<string>")), F.upper))


def is_multiple(question_type: Column, answer: Column) -> Column:
    return F.coalesce(question_type == "X", F.lit(False)) | (F.size(answer) > 1)


def labels_of(options: Column) -> Column:
    return F.transform(options, lambda o: o["label"])


def valid_answer(answer: Column, options: Column) -> Column:
    """Answer labels that exist among the options, order kept."""
    return bind(labels_of(options), lambda labels: F.filter(answer, lambda a: F.array_contains(labels, a)))


def structurally_valid(stem: Column, options: Column, answer: Column, question_type: Column) -> Column:
    """Stem, two or more options, answer present, one answer unless type X, labels known."""
    return (
        (F.length(trim_all(stem)) > 0)
        & (F.size(options) >= 2)
        & (F.size(answer) > 0)
        & (F.coalesce(question_type == "X", F.lit(False)) | (F.size(answer) == 1))
        & (F.size(F.array_except(answer, labels_of(options))) == 0)
    )


def grade(selected: Column, answer: Column) -> Column:
    """correct / wrong; draft while no answer is known; null when nothing was selected."""
    return (
        F.when(F.size(F.coalesce(selected, F.array().cast("array<string>"))) == 0, F.lit(None))
        .when(F.size(F.coalesce(answer, F.array().cast("array<string>"))) == 0, F.lit("draft"))
        .when(F.array_sort(selected) == F.array_sort(answer), F.lit("correct"))
        .otherwise(F.lit("wrong"))
    )


def options_first_wins(options: Column) -> Column:
    """One option per label, the first kept."""
    empty = F.array().cast("array<struct<label:string,text:string>>")
    return F.aggregate(
        options, empty,
        lambda kept, o: F.when(F.exists(kept, lambda k: k["label"] == o["label"]), kept)
        .otherwise(F.array_append(kept, o)),
    )


def options_last_wins(options: Column) -> Column:
    """One option per label, the last text kept at the first position."""
    def pick(label: Column) -> Column:
        own = F.filter(options, lambda o: o["label"] == label)
        return F.struct(label.alias("label"), F.element_at(own, -1)["text"].alias("text"))
    return F.transform(F.array_distinct(F.transform(options, lambda o: o["label"])), pick)


def options_text(options: Column) -> Column:
    """``A.text|B.text`` for display and comparison."""
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit("."), o["text"])), "|")


def quality(stem: Column, options: Column, answer: Column, explanation: Column | None = None) -> Column:
    """Completeness score used to choose between copies of a question."""
    score = (
        F.length(stem)
        + F.aggregate(options, F.lit(0), lambda acc, o: acc + F.length(o["text"]))
        + F.when(F.size(answer) > 0, F.lit(500)).otherwise(F.lit(0))
    )
    if explanation is not None:
        score = score + F.coalesce(F.length(explanation), F.lit(0))
    return score
