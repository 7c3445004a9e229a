"""Constants that decide results, in one place."""

from dataclasses import dataclass

# Thresholds and bounds.
SCANNED_BELOW = 30  # characters of stripped text
DOMINANT_COVER = 0.5
LEAST_IMAGE = 40  # pixels each way
RENDER_DPI = 150
CACHE_DOCUMENTS = 3
LEAST_TERM = 2
LEAST_NUMBER, RUN = 4, (6, 12)  # digits without punctuation, digits in a row
LEAST_TOKEN = 2  # raw characters of a query's token
LEAST_SUBSTRING = 3
FUZZY_RATIO, FUZZY_LENGTH = 0.82, 4
FUZZY_CANDIDATES, FUZZY_POSTINGS = 5, 10
SNIPPET, SNIPPET_KEY = 70, 30
CONTEXT, SMALL_DOCUMENT, TOP_PAGES = 3500, 3, 4
FIELD_SCORE, WORD_SCORE, LONG_WORD = 5, 1, 3
EVIDENCE_PARTS, EVIDENCE_PAGES, EVIDENCE_CHARACTERS = 5, 3, 2500
UPLOAD_BYTES, UPLOAD_PAGES = 50 * 1024 * 1024, 300
LEAST_OCR_WORD, LEAST_HEADER_WORD = 2, 3

# How results name their sources and stages.
LABELS = {"text": "Texto Digital", "ocr": "Escaneo de Página (OCR)", "image_ocr": "Imagen %s (OCR)"}
STAGES = {"exacto": 0, "prefijo": 1, "subcadena": 2, "frase": 3, "difuso": 4}
PAGE_HEADER = "--- PÁGINA %d ---"
EVIDENCE_HEADER = "[Página %d | %s] %s"
MODEL_FAMILY, FALLBACK_MODELS = "qwen", ("qwen2.5:1.5b",)
NOT_FOUND = "No encontrado"
NO_EVIDENCE = "Sin evidencia relevante para la pregunta."
EMPTY_QUESTION = "Pregunta vacía."
BAD_JSON = "El modelo devolvió JSON inválido."


@dataclass(frozen=True)
class Limits:
    """How many queries may be sent to every executor, and how many keys may be looked up by a pushed filter."""

    broadcast_queries: int = 2000
    lookup_keys: int = 500


LIMITS = Limits()
