"""The answer parsers as single column expressions: a strict form, then ordered lenient steps.

A step that finds one distinct letter decides; more than one leaves the answer unparsed. No UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import LETTERS
from .text import folded, lines, plain, strip_reasoning

# fixed values: patterns of the answer forms; (?U) gives Unicode classes as the definition of the forms assumes
LETTER = r"\(?([ABC])\)?(?!\w)"
STRICT_LINE = r"(?iU)\A\W*(?:RESPUESTA|ANSWER)\s*:\s*\(?([ABC])\)?\W*\z"
ANSWER_LINE = r"(?iU)(?:RESPUEST[AEO]|ANSWER)\s*:\s*\(?([ABC])\)?(?!\w)"
NO_COLON_LINE = r"(?U)\A\W*(?:RESPUESTA|ANSWER)\s+\(?([ABC])\)?\W*\z"
PHRASES = (
    r"(?U)(?i:\b(?:respuesta|opci[óo]n|alternativa)\b(?:\s+[a-záéíóúñü]+){0,4}?\s+(?:es|ser[íi]a|parece\s+ser)\s*:?\s*)" + LETTER,
    r"(?U)(?i:\b(?:answer|option|choice)\b(?:\s+[a-z]+){0,4}?\s+(?:is|would\s+be)\s*:?\s*)" + LETTER,
)
REFERENCES = (
    r"(?U)(?i:\b(?:se\s+elige|se\s+selecciona|elijo|escojo|selecciono|elegir[íi]a|me\s+quedo\s+con)\s+(?:la\s+|el\s+)?(?:opci[óo]n|alternativa|respuesta)?\s*)" + LETTER,
    r"(?U)(?i:\bi\s+(?:choose|select|pick)\s+(?:option\s+)?)" + LETTER,
)
REFERENCE_LINE = r"(?U)(?i:\A\W*(?:la\s+|the\s+)?(?:opci[óo]n|option|alternativa)\s*:?\s*)" + LETTER + r"[.)]?\W*\z"
BARE_LETTER = r"(?i)\A\(?([ABC])\)?[.)]?\z"
REFUSALS = (
    "no puedo (responder|ayudar|elegir|escoger|determinar con|proporcionar|cumplir|completar|continuar|emitir|participar|tomar partido|razonar|decirlo)",
    "no me es posible",
    "lo siento",
    "me niego",
    "no es apropiado",
    "no (puedo|debo) hacer suposiciones",
    "como (modelo|asistente|ia|inteligencia artificial)",
    "i can(?:'|’)?t",
    "i cannot",
    "i(?:'|’)?m sorry",
    "i am sorry",
    "i(?:'|’)?m (not able|unable)",
    "as an ai",
    "i won(?:'|’)?t",
    "not appropriate",
)
REFUSAL = "(?iU)(?:" + "|".join(REFUSALS) + ")"
#: A text must hold one of these, in lower case, for the patterns of a step to match: plain searches that spare most
#: texts the regular expressions.
HINTS = {
    "answer": ("respuest", "answer"),
    "phrase": ("respuesta", "opci", "alternativa", "answer", "option", "choice"),
    "reference": ("elige", "selecciona", "elijo", "escojo", "elegir", "quedo", "choose", "select", "pick", "opci", "option", "alternativa"),
    "refusal": ("no puedo", "no me es", "lo siento", "me niego", "no es apropiado", "no debo", "como ", "i can", "i cannot", "m sorry", "i am sorry", "m not able", "m unable", "as an ai", "i won", "not appropriate"),
}

RESULT = "struct<index:int,stage:string,detail:string>"


def _hinted(text: Column, low: Column, step: str) -> Column:
    """Whether ``low``, the lower-cased text, holds a hint; the long s folds to s in patterns but not in lower case."""
    out = F.contains(text, F.lit("ſ"))
    for hint in HINTS[step]:
        out = out | F.contains(low, F.lit(hint))
    return out


def is_refusal(text: Column, low: Column | None = None) -> Column:
    """Whether a refusal pattern occurs; ``low``, if given, is the lower-cased text as a column of its own."""
    return _hinted(text, F.lower(text) if low is None else low, "refusal") & text.rlike(REFUSAL)


def _result(index: Column, stage: str, detail: str) -> Column:
    return F.struct(index.cast("int").alias("index"), F.lit(stage).alias("stage"), F.lit(detail).alias("detail"))


def _none(detail: str) -> Column:
    return _result(F.lit(None), "none", detail)


def _index(letter: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LETTERS)), F.upper(letter)) - 1


def _found(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))


def _on_lines(rows: Column, pattern: str) -> Column:
    return F.filter(F.transform(rows, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")


def _when(step: str, letters: Column) -> Column:
    return F.when(_hinted(F.col("_t"), F.col("_low"), step), letters).otherwise(F.array().cast("array<string>"))


def _steps(text: Column, strict: Column, letters: dict[str, Column], bare: Column, refused: Column, options: Column) -> Column:
    out = F.when(text == "", _none("no_match")).when(strict != "", _result(_index(strict), "strict", "last_line"))
    for detail, found in letters.items():
        out = out.when(F.size(found) == 1, _result(_index(F.get(found, F.lit(0))), "lenient", detail)).when(F.size(found) > 1, _none("multiple_options"))
    out = out.when(bare != "", _result(_index(bare), "lenient", "bare_letter")).when(refused, _none("refusal_text"))
    out = out.when(F.size(options) == 1, _result(F.get(options, F.lit(0)), "lenient", "option_text")).when(F.size(options) > 1, _none("multiple_options"))
    return out.otherwise(_none("no_match"))


def _three(choices: str = "choices") -> Column:
    """``choices``, or an error if there are not three."""
    return F.when(F.size(choices) == 3, F.col(choices)).otherwise(F.raise_error(F.lit("exactly 3 choices are needed")).cast("array<string>"))


def read_clean(df: DataFrame) -> DataFrame:
    """Adds ``parse`` (index 0..2 or null, stage, detail) for free answers in ``completion`` with three ``choices``.

    Texts that several steps use are columns of their own, which the optimizer computes once a row.
    """
    c = F.col
    df = df.withColumn("_t", plain(strip_reasoning(F.coalesce("completion", F.lit("")))))
    df = df.withColumns({"_rows": F.filter(lines(c("_t")), lambda x: x != ""), "_fold": folded(c("_t")), "_low": F.lower(c("_t")), "_names": F.transform(_three(), folded)})
    inside = lambda i, j: (F.get("_names", i) != F.get("_names", j)) & F.contains(F.get("_names", j), F.get("_names", i))
    df = df.withColumns({
        "_strict": F.regexp_extract(F.coalesce(F.try_element_at("_rows", F.lit(-1)), F.lit("")), STRICT_LINE, 1),
        "_answer": _when("answer", F.array_distinct(F.concat(F.transform(F.regexp_extract_all("_t", F.lit(ANSWER_LINE), F.lit(1)), lambda x: F.upper(x)), _on_lines(c("_rows"), NO_COLON_LINE)))),
        "_phrase": _when("phrase", _found(c("_t"), PHRASES)),
        "_option": _when("reference", F.array_union(_found(c("_t"), REFERENCES), _on_lines(c("_rows"), REFERENCE_LINE))),
        "_bare": F.regexp_extract("_t", BARE_LETTER, 1),
        "_refused": is_refusal(c("_t"), c("_low")),
        "_present": F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.get("_names", i) != "") & F.contains(c("_fold"), F.get("_names", i))),
    })
    df = df.withColumn("_in", F.filter("_present", lambda i: ~F.exists("_present", lambda j: inside(i, j))))
    letters = {"answer_line": c("_answer"), "answer_phrase": c("_phrase"), "option_ref": c("_option")}
    df = df.withColumn("parse", _steps(c("_t"), c("_strict"), letters, c("_bare"), c("_refused"), c("_in")))
    return df.drop("_t", "_rows", "_fold", "_low", "_names", "_strict", "_answer", "_phrase", "_option", "_bare", "_refused", "_present", "_in")


def read_paper(df: DataFrame) -> DataFrame:
    """Adds ``parse`` for answers in the published form: for each option in turn an exact form, then containment; the first wins."""
    df = df.withColumns({"_t": strip_reasoning(F.coalesce("completion", F.lit(""))), "_three": _three()})
    text = F.col("_t")
    out = F.when(text == "", _none("no_match"))
    for i in range(3):
        value = F.get("_three", F.lit(i))
        exact = (text == F.concat(F.lit(f"Option {i}: "), value)) | (text == F.concat(F.lit(f"{i}: "), value)) | (text == str(i))
        out = out.when(exact, _result(F.lit(i), "strict", "exact_form")).when((value != "") & F.contains(text, value), _result(F.lit(i), "lenient", "option_text"))
    return df.withColumn("parse", out.otherwise(_none("no_match"))).drop("_t", "_three")


def outcome(index: Column, text: Column, stop_reason: Column, low: Column | None = None) -> Column:
    """How a response counts: answered, no_response, refusal or invalid, tested in this order."""
    return (
        F.when(index.isNotNull(), "answered").when(text == "", "no_response")
        .when((F.coalesce(stop_reason, F.lit("")) == "content_filter") | is_refusal(text, low), "refusal").otherwise("invalid_response_format")
    )
