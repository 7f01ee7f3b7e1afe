"""Language of a text by a stop-word vote (SQL text in, SQL text out).

Texts under 50 characters and texts without any stop word are ``unknown``.
Otherwise the language with most stop words wins, the smaller code on a tie.
"""

from pagewarden import lexicon
from pagewarden.functions import text as tx


def stop_words(text: str) -> str:
    """The words of a text that are a stop word of any language."""
    w = tx.fresh("w")
    known = sorted({word for words in lexicon.STOP_WORDS.values() for word in words})
    return (f"filter(split(lower({text}), {tx.pattern(r'[^\p{L}]+')}), "
            f"{w} -> {tx.in_list(w, known)})")


def best_language(word_array: str) -> str:
    """(negative hits, language) of the winning language."""
    w = tx.fresh("w")
    votes = ", ".join(
        f"named_struct('rank', -size(filter({word_array}, "
        f"{w} -> {tx.in_list(w, stop)})), 'lang', '{lang}')"
        for lang, stop in sorted(lexicon.STOP_WORDS.items())
    )
    return f"array_min(array({votes}))"


def detect(text: str) -> str:
    voted = tx.let(
        tx.let(stop_words(text), best_language),
        lambda b: f"CASE WHEN {b}.rank = 0 THEN '{lexicon.LANGUAGE_UNKNOWN}' ELSE {b}.lang END",
    )
    return (f"CASE WHEN length({tx.strip(text)}) < {lexicon.LANGUAGE_MIN_CHARS} "
            f"THEN '{lexicon.LANGUAGE_UNKNOWN}' ELSE {voted} END")
