"""Extractors of paged files and images: PDF text layers, and recognition by a model that is plugged in.

Neither a PDF library nor a recognition model belongs to this package. ``PdfExtractor`` uses pypdf where it is installed, or
any ``reader``; ``recognise`` turns the bytes of an image into text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from loamstack.functions.chunking import WHITE
from loamstack.functions.text import LIGATURES
from loamstack.sources.corpus import Extractor, NoText

MAX_FILE_BYTES = 64 << 20
# Kinds of image files.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")

_GAP = re.compile(f"[{WHITE}]+")


def _lines(text: str) -> list[str]:
    return [_GAP.sub(" ", line).strip(WHITE) for line in text.replace("\r\n", "\n").split("\n")]


def clean(text: str) -> str:
    """As ``functions.text.clean``, for one text."""
    for sign, letters in LIGATURES.items():
        text = text.replace(sign, letters)
    whole = re.sub(r"\n{2,}", "\n\n", "\n".join(_lines(text))).strip("\n")
    return re.sub(r"-\n(?=(.))", lambda m: "" if m[1].islower() else m[0], whole)


def tidy(text: str) -> str:
    """As ``functions.text.tidy``, for one text."""
    return "\n".join(line for line in _lines(text) if line)


def has_text(text: str) -> bool:
    """As ``functions.text.has_text``, for one text."""
    return sum(sum(c.isalnum() for c in word) >= 2 for word in _GAP.split(text)) >= 2


@dataclass
class Page:
    """A page's text layer and the images on it."""

    text: str
    images: list[bytes]


def pypdf_pages(path: str) -> Iterable[Page]:
    """Pages of a PDF by pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF needs pypdf, or a reader of your own") from error
    for page in PdfReader(path).pages:
        yield Page(page.extract_text() or "", [image.data for image in page.images])


def _recognised(images: list[bytes], recognise: Callable[[bytes], str] | None) -> str:
    found = [tidy(recognise(image)) for image in images] if recognise else []
    return "\n".join(text for text in found if has_text(text))


@dataclass
class PdfExtractor(Extractor):
    """Sections of a PDF, one a page that has text, with its number. Pages without a text layer are recognised, if they have
    images and there is a ``recognise``. A PDF without any text is an empty file (NoText); one that cannot be read fails."""

    extensions: tuple[str, ...] = ("pdf",)
    extract: Callable[[str], list[tuple[str, int | None]]] | None = None
    max_file_bytes: int = MAX_FILE_BYTES
    reader: Callable[[str], Iterable[Page]] = pypdf_pages
    recognise: Callable[[bytes], str] | None = None

    def __post_init__(self) -> None:
        self.extract = self._extract

    def _extract(self, path: str) -> list[tuple[str, int | None]]:
        found = []
        for number, page in enumerate(self.reader(path), 1):
            text = clean(page.text)
            if not text:
                text = _recognised(page.images, self.recognise)
            if text:
                found.append((text, number))
        if not found:
            raise NoText(f"{path}: no text layer")
        return found


@dataclass
class ImageExtractor(Extractor):
    """The text of an image by ``recognise``; what is hardly text makes it an empty file."""

    extensions: tuple[str, ...] = IMAGES
    extract: Callable[[str], list[tuple[str, int | None]]] | None = None
    max_file_bytes: int = MAX_FILE_BYTES
    recognise: Callable[[bytes], str] | None = None

    def __post_init__(self) -> None:
        if self.recognise is None:
            raise ValueError("an image extractor needs recognise")
        self.extract = self._extract

    def _extract(self, path: str) -> list[tuple[str, int | None]]:
        text = _recognised([Path(path).read_bytes()], self.recognise)
        if not text:
            raise NoText(f"{path}: no text in the image")
        return [(text, None)]
