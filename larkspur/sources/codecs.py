"""Binary codecs and decoders of document files, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    """The inverse; a blob that is no whole number of floats is null."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").astype(np.float32))


def docx_paragraphs(data: bytes) -> str | None:
    """Text of body paragraphs in order, a line for each; null where the bytes are no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


@F.pandas_udf(T.StringType())
def docx_text(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else docx_paragraphs(b))


_stream = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_shown = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT\*|\bT[dDJjm]\b|\bET\b|'", re.S)
_escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(s: bytes) -> bytes:
    def one(m):
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _escapes.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, s, flags=re.S)


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page of 50 bytes or more; where there is no page tree, that of each content stream, in the usual encoding."""
    found = pdf.pages_of(data)
    if found is not None:
        return found
    pages = []
    for head, body in _stream.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        out: list[bytes] = []
        for token in _shown.findall(body):
            if token[:1] == b"(":
                out.append(_literal(token[1:-1]))
            elif token[:1] == b"<":
                digits = re.sub(rb"\s", b"", token[1:-1])
                out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
            elif token in (b"Td", b"TD", b"T*", b"ET", b"'"):
                out.append(b"\n")
        text = re.sub(r"\n+", "\n", b"".join(out).decode("latin-1")).strip()
        if len(text.encode()) >= 50:
            pages.append(text)
    return pages


@F.pandas_udf(T.ArrayType(T.StringType()))
def pdf_text(data: pd.Series) -> pd.Series:
    """Pages; no text in a readable encoding gives an empty array."""
    return data.map(lambda b: None if b is None else pdf_pages(b))
