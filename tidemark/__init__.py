"""Timestamped events in long recordings, and text corpora, on Spark."""

from importlib import import_module

#: Public names and where they live; they are imported when first used.
_PUBLIC = {
    "detect": "tidemark.detection", "class_runs": "tidemark.detection", "register": "tidemark.detection", "load_audio": "tidemark.sources.audio:decode",
    "rich_transcript": "tidemark.operators.transcript", "clean": "tidemark.operators.transcript:suppress_spoken", "EVENTS": "tidemark.functions.taxonomy",
    "INLINE": "tidemark.functions.taxonomy", "SPEAKER_EVENTS": "tidemark.functions.taxonomy", "BACKGROUND_EVENTS": "tidemark.functions.taxonomy",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, _, other = _PUBLIC[name].partition(":")
    value = getattr(import_module(module), other or name)
    globals()[name] = value  # before a submodule of that name
    return value
