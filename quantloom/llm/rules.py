"""Quality rules, line first: lines that fail are removed, then documents that lose too much are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, unused, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Phrases of page furniture and licence lines, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use cookies", "enable javascript", "click here", "read more", "share this", "sign in", "log in",
    "subscribe to", "skip to content", "back to top", "powered by",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "weiterlesen", "zum inhalt springen",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "lire la suite", "se connecter", "aller au contenu",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "leer más", "iniciar sesión", "ir al contenido",
)
# What ends a sentence, what may close after it, and what may follow unseen.
ENDS, CLOSERS, UNSEEN = ".!?…。！？", "\"')]”’»", SPACE_CHARS + "\u0085\u2028\u2029"
#: A document is rejected if it keeps less than this share of its characters.
MIN_KEPT = 0.5


def filled(line: Column) -> Column:
    """Whether a line has a word."""
    return F.trim(line, F.lit(SPACE_CHARS)) != ""


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(lines, filled), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(tokens: Column, k: int = WINDOW) -> Column:
    """Words in k-word windows that occur twice or more in the text, the first occurrence included.

    Windows are told apart by 64-bit hashes.  Only texts with equal windows
    sort them: neighbours in hash order give the positions, and each position
    covers what the next one doesn't.
    """

    def spread(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hit(s: Column) -> Column:
            near = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])))
            at = F.array_sort(F.transform(near, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(k), lambda acc, j: acc + F.least(F.lit(k), p[j] - p[j - 1])))

        return let(placed, hit)

    def windows(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))
        return F.when(n <= k, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spread(h))))

    return let(F.transform(tokens, lambda x: F.xxhash64(x)), windows).cast("long")


def _count(text: Column, chars: str) -> Column:
    """How many characters of a text are among a few ASCII ones."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c for c in chars) + "]"))


def _solid(text: Column) -> Column:
    """Characters that belong to words."""
    return F.length(F.translate(text, SPACE_CHARS, ""))


def line_ok(line: Column, symbols: Column) -> Column:
    """The rules of one line: ends like a sentence, is no menu, no page furniture, no shouting, no symbol soup.

    ``symbols`` says whether the whole text has any; where it has none, no
    line needs to be searched.
    """
    end = F.substring(F.rtrim(F.rtrim(line, F.lit(UNSEEN)), F.lit(CLOSERS)), -1, 1)
    sentence = (end != "") & (F.instr(F.lit(ENDS), end) > 0)
    menu = _count(line, "|") >= 2
    soup = _count(line, SYMBOLS) * 20 > _solid(line)
    # More than half of the characters can only be capitals if two of them are neighbours.
    near = line.rlike(r"[A-Z]\s*[A-Z]")
    shouting = (_solid(line) > 20) & (F.regexp_count(line, F.lit("[A-Z]")) * 2 > _solid(line))
    clean = F.when(symbols, ~(menu | soup)).otherwise(F.lit(True))
    plain = ~let(F.lower(line), lambda x: _any(x, BOILERPLATE))
    return sentence & clean & plain & F.when(near, ~shouting).otherwise(F.lit(True))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def clean_lines(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``clean_text`` (the lines that pass).

    A null text counts as empty; texts without words fail the base rule and
    are not kept.  Blank lines pass.  Rows are judged one by one, so repeated
    rows get equal verdicts, and an empty table stays empty.  Columns of the
    added names are replaced; others stay, whatever they are called.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found, lines, clean = (unused(docs, x) for x in ("found", "lines", "clean"))
    left = F.when(F.size(clean) == F.size(lines), F.col("word_chars")).otherwise(_solid(F.array_join(clean, "\n")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("repeated"), F.length(F.array_join(w, "")).cast("long").alias("chars"))
    return (
        docs.withColumns({found: let(words(F.col("text")), of_words), lines: F.split(text, "\n"), "n_symbols": _count(text, SYMBOLS).cast("long")})
        .withColumns({"n_words": F.col(f"`{found}`.n_words"), "n_repeat_words": F.col(f"`{found}`.repeated"), "word_chars": F.col(f"`{found}`.chars"), "n_dup_lines": duplicate_lines(F.col(lines))})
        .withColumn(clean, F.filter(lines, lambda x: ~filled(x) | line_ok(x, F.col("n_symbols") > 0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= min_kept * F.col("word_chars")))
        .withColumn("clean_text", F.array_join(clean, "\n"))
        .drop(found, lines, clean)
    )


def op9_rules(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, the counts, base_failed and kept; see ``clean_lines``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
