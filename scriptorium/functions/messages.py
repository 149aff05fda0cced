"""What each code reports, in two languages: a table that diagnostics are joined with."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = "en"
#: code | English | French. `{name}` stands for a field.
_ENTRIES = """
unclosed-brace | a brace is never closed | une accolade n'est jamais fermée
extra-brace | a brace closes nothing | une accolade ne ferme rien
unclosed-bracket | an optional argument is never closed | un argument optionnel n'est jamais fermé
unclosed-environment | an environment is never closed | un environnement n'est jamais fermé
end-without-begin | the end of an environment that was not begun | la fin d'un environnement qui n'a pas commencé
crossed-environment | an environment is closed by the end of another | un environnement est fermé par la fin d'un autre
crossed-environments | two ends of environments are in the wrong order | deux fins d'environnements sont dans le mauvais ordre
unclosed-math | a formula is never closed | une formule n'est jamais fermée
dollar-in-math | a dollar within a formula of another kind | un dollar dans une formule d'un autre genre
math-in-math | a formula is opened within a formula | une formule est ouverte dans une formule
stray-math-close | the end of a formula that was not opened | la fin d'une formule qui n'est pas ouverte
unclosed-verbatim | verbatim text is never closed | un texte verbatim n'est jamais fermé
verb-across-lines | a verbatim command must end on its line | une commande verbatim doit finir sur sa ligne
verbatim-braces | braces don't match in a verbatim argument | des accolades ne se répondent pas dans un argument verbatim
item-outside-list | an item outside a list | un élément hors d'une liste
ampersand-outside-alignment | an alignment mark outside an alignment | une marque d'alignement hors d'un alignement
script-outside-math | a script outside a formula | un indice ou un exposant hors d'une formule
double-subscript | a second subscript | un second indice
double-superscript | a second superscript | un second exposant
script-without-argument | a script of nothing | un indice ou un exposant de rien
limits-without-operator | limits of what is no operator | des limites sans opérateur
ambiguous-fraction | a second fraction in one list | une seconde fraction dans une même liste
missing-delimiter | a delimiter is missing | un délimiteur manque
middle-without-left | a middle delimiter without a left one | un délimiteur du milieu sans celui de gauche
right-without-left | a right delimiter without a left one | un délimiteur de droite sans celui de gauche
left-without-right | a left delimiter without a right one | un délimiteur de gauche sans celui de droite
left-across-cells | a cell ends before a delimiter is closed | une cellule finit avant qu'un délimiteur ne soit fermé
too-many-columns | more cells than columns | plus de cellules que de colonnes
misplaced-rule | a rule within a row | un filet au milieu d'une ligne
misplaced-multicolumn | a span within a cell | une fusion au milieu d'une cellule
unknown-column | a column of no known kind | une colonne de genre inconnu
display-in-math | a display within a formula | une formule hors texte dans une formule
math-command-in-text | a command of formulas in text | une commande de formule dans le texte
blank-line-in-math | an empty line in a formula | une ligne vide dans une formule
multiple-labels | a second label in an equation | un second label dans une équation
multiple-tags | a second tag in an equation | un second tag dans une équation
tag-not-allowed | a tag outside a display | un tag hors d'une formule hors texte
invalid-length | not a length | ce n'est pas une longueur
text-before-item | text before the first item | du texte avant le premier élément
too-deeply-nested | lists are nested too deeply | des listes sont imbriquées trop profondément
preamble-only | this belongs in the preamble | ceci va dans le préambule
text-in-preamble | text in the preamble | du texte dans le préambule
illegal-parameter | a parameter that there is not | un paramètre qui n'existe pas
already-defined | a name is defined already | un nom est déjà défini
not-a-command-name | this is no name of a command | ce n'est pas un nom de commande
verb-in-argument | verbatim in an argument | du verbatim dans un argument
float-in-box | a float in a box | un flottant dans une boîte
caption-outside-float | a caption outside a float | une légende hors d'un flottant
blank-line-in-argument | an empty line in a short argument | une ligne vide dans un argument court
invalid-in-math | a command of text in a formula | une commande de texte dans une formule
missing-argument | an argument is missing | un argument manque
line-break-without-line | there is no line to break | il n'y a pas de ligne à couper
file-not-found | {target} is not found | {target} est introuvable
unknown-command | {name}: did you mean {known}? | {name} : vouliez-vous dire {known} ?
unknown-environment | {name}: did you mean {known}? | {name} : vouliez-vous dire {known} ?
"""
#: Whole messages, where a title doesn't tell all: code | English | French. Fixed places of fields; what a field is called is in FIELDS.
_WHOLE = r"""
unclosed-brace | {opening} is not closed before {cause} | {opening} n'est pas fermé avant {cause}
unclosed-bracket | {opening} is not closed before {cause} | {opening} n'est pas fermé avant {cause}
unclosed-math | {opening} is not closed before {cause} | {opening} n'est pas fermé avant {cause}
unclosed-environment | {opening} is not closed before {cause} | l'environnement {opening} n'est pas fermé avant {cause}
end-without-begin | no {name} is open | aucun environnement {name} n'est ouvert
dollar-in-math | a dollar within {opening} | un dollar dans {opening}
unclosed-verbatim | {name} is never closed | {name} n'est jamais fermé
verb-across-lines | {name} must end on its line | {name} doit finir sur sa ligne
too-many-columns | {cells} cells in a row of {columns} columns | {cells} cellules dans une ligne de {columns} colonnes
unknown-column | unknown column in {spec} | colonne inconnue dans {spec}
illegal-parameter | parameter {number} of {arity} | paramètre {number} sur {arity}
already-defined | {name} is already defined | {name} est déjà défini
file-not-found | {target} is not found | {target} est introuvable
unknown-command | {name}: did you mean {known}? | {name} : vouliez-vous dire {known} ?
unknown-environment | {name}: did you mean {known}? | {name} : vouliez-vous dire {known} ?
"""
#: What is said of a place that a macro wrote, after the message.
WRITTEN_BY = {"en": " (written by {macro})", "fr": " (écrit par {macro})"}
_LANGUAGES = ("en", "fr")
_current = [FALLBACK]


def _table() -> dict[tuple[str, str], str]:
    rows = [[x.strip() for x in row.split(" | ")] for row in _ENTRIES.strip().splitlines()]
    return {(language, row[0]): row[k + 1] for row in rows for k, language in enumerate(_LANGUAGES)}


MESSAGES = _table()


def languages() -> tuple[str, ...]:
    return _LANGUAGES


def language() -> str:
    return _current[0]


def set_language(name: str) -> None:
    """The language that say() and described() use; one that isn't there is an error."""
    if name not in _LANGUAGES:
        raise ValueError(f"no messages in {name}")
    _current[0] = name


def say(key: str, **fields: object) -> str:
    """A message with its fields filled in; in English where the language lacks it, the key where nobody has it."""
    text = MESSAGES.get((language(), key), MESSAGES.get((FALLBACK, key), key))
    for name, value in fields.items():
        text = text.replace(f"{{{name}}}", str(value))
    return text


def catalogue(spark: SparkSession) -> DataFrame:
    """(language, code, title): all messages; a fixed table."""
    return spark.createDataFrame([(lang, code, text) for (lang, code), text in sorted(MESSAGES.items())], "language string, code string, title string")


def described(found: DataFrame, name: str | None = None) -> DataFrame:
    """Diagnostics with `title`, what their code reports in a language; in English where it lacks that."""
    told = catalogue(found.sparkSession)
    own = told.filter(F.col("language") == (name or language())).select("code", F.col("title").alias("__own"))
    other = told.filter(F.col("language") == FALLBACK).select("code", F.col("title").alias("__other"))
    return found.join(F.broadcast(other), "code", "left").join(F.broadcast(own), "code", "left").withColumn("title", F.coalesce("__own", "__other", "code")).drop("__own", "__other")


def _whole() -> dict[tuple[str, str], str]:
    rows = [[x.strip() for x in row.split(" | ")] for row in _WHOLE.strip().splitlines()]
    return {(language, row[0]): row[k + 1] for row in rows for k, language in enumerate(_LANGUAGES)}


WHOLE = _whole()


def _pattern(template: str) -> str:
    """What matches a message of a template, with a group for each field."""
    return "^" + "".join("(.*)" if part.startswith("{") else re.escape(part) for part in re.split(r"(\{\w+\})", template)) + "$"


def with_fields(found: DataFrame) -> DataFrame:
    """Diagnostics with `fields`, a map: what their message tells besides its code, and `macro` where a macro wrote the place."""
    own = F.create_map().cast("map<string,string>")
    bare = F.regexp_replace("message", r" \(written by (\\[^ ]+)\)$", "")
    for (language, code), template in WHOLE.items():
        if language == FALLBACK:
            names = re.findall(r"\{(\w+)\}", template)
            pattern = _pattern(template)
            made = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.regexp_extract(bare, pattern, k + 1) for k in range(len(names)))))
            own = F.when((F.col("code") == code) & bare.rlike(pattern), made).otherwise(own)
    macro = F.regexp_extract("message", r" \(written by (\\[^ ]+)\)$", 1)
    return found.withColumn("fields", F.when(macro != "", F.map_concat(own, F.create_map(F.lit("macro"), macro))).otherwise(own))


def filled(template: Column, fields: Column) -> Column:
    """A template with its fields filled in, by a fold over the map."""
    return F.aggregate(F.map_entries(fields), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def told(found: DataFrame, name: str | None = None) -> DataFrame:
    """Diagnostics with `told`, their whole message in a language: its template with the fields filled in; in English where the language lacks it."""
    lang = name or language()
    if lang not in _LANGUAGES:
        raise ValueError(f"no messages in {lang}")
    rows = {code: WHOLE.get((lang, code)) if (lang, code) in WHOLE else MESSAGES.get((lang, code)) for _, code in MESSAGES}
    table = F.create_map(*(F.lit(x) for code, text in rows.items() if text for x in (code, text)))
    fields = with_fields(found)
    # A template whose fields this message doesn't have gives way to the code's title.
    title = F.create_map(*(F.lit(x) for (own, code), text in MESSAGES.items() if own == lang for x in (code, text)))
    whole = F.coalesce(F.try_element_at(table, F.col("code")), F.col("message"))
    lacks = whole.contains("{") & (F.size(F.map_filter("fields", lambda k, v: k != "macro")) == 0)
    text = filled(F.when(lacks, F.coalesce(F.try_element_at(title, F.col("code")), F.col("message"))).otherwise(whole), F.col("fields"))
    by = F.when(F.map_contains_key("fields", "macro"), filled(F.lit(WRITTEN_BY[lang]), F.col("fields"))).otherwise("")
    return fields.withColumn("told", F.concat(text, by))
