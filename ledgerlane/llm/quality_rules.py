"""Quality rules: lines are judged first and failing ones removed; a document that loses too much text is rejected.

Line rules, on every line that has a word:
navigation (parts between ``|``), symbols (too many marks among the characters), shouting (nearly all letters
upper case), boilerplate (a short line has a phrase of rights, licences, cookies or menus in one of four languages, or is no more than such a word), repetition (a few
words make up a long line) and punctuation (a short line without any sentence end).
Document rules come first and only from the text itself: too few words, or too many words in repeated windows.

All work is within one document, so there is no shuffle and no key. Null text has no words and is rejected;
empty texts, repeated rows, nulls in the id and other columns are kept as they come. A text is handled whole:
memory grows with the longest text only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_batches, utf8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, removed_chars long"
)

# Fixed values.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
# Phrases that only stand in boilerplate, in English, German, French and Spanish: a short line with one goes. Single words that
# prose uses as well (cookie, copyright, newsletter) aren't among them.
BOILERPLATE = re.compile(
    r"all rights reserved|copyright\s*(?:©|\(c\)|\d{4})|©\s*\d{4}|licensed under|released under the|terms of (?:use|service)|privacy policy|(?:we|site|page|website) uses? cookies|accept (?:all |our )?cookies|cookie (?:policy|settings|preferences|notice)"
    r"|enable javascript|javascript (?:is disabled|to view)|subscribe (?:to|now|for)|sign (?:in|up) (?:to|for|now|here|with)|log ?in (?:to|here|with)|click here|read more|share this|lorem ipsum|powered by|(?:our|the|free|weekly|daily) newsletter (?:sign|subscri)|newsletter sign-?up"
    r"|alle rechte vorbehalten|lizenziert unter|steht unter (?:der|einer) .{0,30}lizenz|nutzungsbedingungen|datenschutzerklärung|(?:verwendet|nutzt|verwenden|nutzen) cookies|cookies? akzeptieren|hier klicken|jetzt anmelden|newsletter (?:abonnieren|bestellen)"
    r"|tous droits réservés|sous licence|conditions d['’]utilisation|politique de confidentialité|mentions légales|(?:utilise|utilisons) des cookies|accepter les cookies|cliquez ici|lire la suite|abonnez-vous"
    r"|todos los derechos reservados|bajo licencia|condiciones de uso|política de privacidad|aviso legal|(?:utiliza|usa|utilizamos|usamos) cookies|aceptar (?:las )?cookies|haga clic aquí|haz clic aquí|leer más|suscríbete"
)
# Words that are boilerplate where they are all that a line says.
HEADINGS = re.compile(r"(?:impressum|datenschutz|urheberrecht|newsletter|copyright|cookies?|login|log ?in|sign ?in|sign ?up|subscribe|weiterlesen|se connecter|iniciar sesión|droits? d['’]auteur|derechos de autor)(?:\W+\w+)?\W*")
SENTENCE_END = re.compile(rb"[.!?;:](?:[\"')\]]|\xe2\x80[\x99\x9d])*(?:\s|$)|\xe2\x80\xa6|[\xe3][\x80][\x82]|\xef\xbc[\x81\x9f]|\xd8\x9f|\xe0\xa5\xa4")
ACCENTED_UPPER = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
ACCENTED = re.compile(rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]")


@dataclass(frozen=True)
class Limits:
    """``window`` words make a window; ``max_loss`` is the share of word characters that a kept document may lose."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_loss: float = 0.5
    max_symbols: float = 0.1
    max_upper: float = 0.7
    min_letters: int = 20
    boilerplate_words: int = 16
    repeat_words: int = 20
    short_words: int = 10
    min_distinct: float = 0.2


def word_chars(data: bytes) -> int:
    """Code points that are not white space."""
    return len(data.translate(None, SPACE + CONTINUATION))


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` words that occur at least twice. Exact: windows are named by doubling, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    names = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == len(words):
        return 0
    have = 1
    while have < window:
        step = min(have, window - have)
        left, right = names[: len(names) - step], names[step:]
        found, names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)
        if len(found) == len(names):
            return 0
        have += step
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def line_fails(line: bytes, limits: Limits) -> bool:
    """Whether a line (with a word in it) breaks one of the line rules."""
    words = line.split()
    pipes = line.count(b"|")
    if pipes >= 3 and pipes * 5 >= len(words):
        return True
    chars = word_chars(line)
    if chars - len(line.translate(None, SPACE + CONTINUATION + SYMBOLS)) > limits.max_symbols * chars:
        return True
    accented = ACCENTED.findall(line)
    upper = len(re.findall(rb"[A-Z]", line)) + len(ACCENTED_UPPER.findall(line))
    letters = len(re.findall(rb"[A-Za-z]", line)) + len(accented)
    if letters >= limits.min_letters and upper > limits.max_upper * letters:
        return True
    if len(words) <= limits.boilerplate_words:
        said = line.decode(errors="replace").strip().lower()
        if BOILERPLATE.search(said) or HEADINGS.fullmatch(said):
            return True
    if len(words) >= limits.repeat_words and len(set(words)) < limits.min_distinct * len(words):
        return True
    return len(words) < limits.short_words and not SENTENCE_END.search(line)


def judge(data: bytes, limits: Limits = Limits()) -> tuple[dict, bytes]:
    """The counts and verdict of one text, and the text without its failing lines."""
    words = data.split()
    lines = data.split(b"\n")
    full = [line for line in lines if line.strip()]
    chars = word_chars(data)
    repeat = repeated_words(words, limits.window)
    base_failed = len(words) < limits.min_words or 100 * repeat > limits.max_repeat_percent * len(words)
    failing = {line for line in set(full) if line_fails(line, limits)}
    gone = [line for line in full if line in failing]
    lost = sum(map(word_chars, gone))
    row = {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": repeat, "base_failed": base_failed,
        "kept": not base_failed and lost <= limits.max_loss * chars, "n_lines": len(full), "n_removed_lines": len(gone), "removed_chars": lost,
    }
    return row, (b"\n".join(line for line in lines if line not in failing) if gone else data)


def quality_report(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts and verdict (see the module's cases)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge(data, limits)[0] for data in utf8(batch)]
            return columns(doc_id=batch.column("doc_id"), **{k: [r[k] for r in rows] for k in rows[0]})

        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, SCHEMA)


def clean_documents(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, with all their columns, their failing lines removed and ``length_col`` (if there) set anew."""
    schema = docs.schema

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, cleaned = [], []
            for i, data in enumerate(utf8(batch, text_col)):
                row, text = judge(data, limits)
                if row["kept"]:
                    kept.append(i)
                    cleaned.append(text.decode())
            out = batch.take(pa.array(kept, pa.int64()))
            at = out.schema.get_field_index(text_col)
            out = out.set_column(at, out.schema.field(at), pa.array(cleaned, out.schema.field(at).type))
            if length_col and (at := out.schema.get_field_index(length_col)) >= 0:
                out = out.set_column(at, out.schema.field(at), pa.array([len(x) for x in cleaned]).cast(out.schema.field(at).type))
            return out

        return step

    return map_batches(docs, make, schema)


__all__ = ["Limits", "clean_documents", "judge", "quality_report", "repeated_words"]
