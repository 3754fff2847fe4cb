"""Emotion by lexicon: the native stand-in for a model call, with the same output domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import tokens

NEUTRAL = "Neutral"
PREFIX_CHARS = 800

# Fixed values of this library: cue words per emotion, most telling emotion first.
LEXICON = {
    "Anger": ("hate", "rage", "furious", "angry", "idiot", "moron", "stupid", "clown"),
    "Disgust": ("disgusting", "scum", "trash", "filthy", "gross", "vile"),
    "Sadness": ("sad", "grief", "lonely", "cry", "worthless", "pathetic", "loser"),
    "Fear": ("fear", "afraid", "terror", "danger", "panic", "anxious"),
    "Joy": ("joy", "happy", "delight", "glad", "smile", "cheerful"),
    "Love": ("love", "dear", "beloved", "adore", "tender"),
    "Surprise": ("surprise", "sudden", "astonished", "unexpected", "amazed"),
}


def _among(cues: tuple[str, ...]):
    return lambda w: w.isin(*cues)


def emotion_of(text: Column, lexicon: dict[str, tuple[str, ...]] = LEXICON) -> Column:
    """The emotion with most cue words; the earlier one on a tie; Neutral when there is none."""
    def best(words: Column) -> Column:
        scored = [F.struct(F.lit(0).alias("n"), F.lit(1).alias("tie"), F.lit(NEUTRAL).alias("name"))]
        for i, (name, cues) in enumerate(lexicon.items()):
            n = F.size(F.filter(words, _among(cues)))
            scored.append(F.struct(n.alias("n"), F.lit(-i).alias("tie"), F.lit(name).alias("name")))
        return F.array_max(F.array(*scored))["name"]
    # One-element transform: the words are split once, not once per emotion; few are cues, and those are counted.
    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    words = F.filter(words, _among(tuple(dict.fromkeys(cue for cues in lexicon.values() for cue in cues))))
    return F.element_at(F.transform(F.array(words), best), 1)


def prefix(text: Column, chars: int = PREFIX_CHARS) -> Column:
    """What the classifier looks at: the label of a text is defined by its start."""
    return F.substring(text, 1, chars)
