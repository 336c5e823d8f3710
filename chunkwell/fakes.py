"""What stands in for libraries and services that are not here: recognition, PDF, embeddings and completions; for queries over the given tables."""

from __future__ import annotations

import json

from .sources import adapters


class Pages(adapters.Recogniser):
    """Pages of a file are what lies between blank lines; a mode's confidence follows from the text's length."""

    def page(self, content, number):
        return content.decode().split("\n\n")[number - 1]

    def count(self, content):
        return content.decode().count("\n\n") + 1

    def plate(self, content):
        return content.decode()

    def words(self, picture, mode):
        n = len(picture)
        return picture, [float(n % 100), -1.0] if mode == 6 else [float(n % 90 + 4), float(n % 90 + 6)]


def pdf(content: bytes, doc_id: str):
    """Every third page is a picture."""
    for i, text in enumerate(content.decode().split("\n\n"), 1):
        if i % 3 == 0:
            yield {"type": "needs_ocr", "page": i}
        elif text.strip():
            yield {"type": "text", "page": i, "text": text}


def embeddings(url: str, headers: dict, body: dict) -> tuple[int, bytes]:
    side = 1.0 if body["input_type"] == "document" else 2.0
    data = [{"embedding": [float(len(x)), side], "index": i} for i, x in enumerate(body["input"])]
    return 200, json.dumps({"data": data[::-1]}).encode()


def completions(url: str, headers: dict, body: dict) -> tuple[int, bytes]:
    """Plans a lookup of what the question names, has enough after two searches, and cites one document."""
    asked = body["response_format"]["json_schema"]["schema"]["properties"]
    text = body["messages"][-1]["content"]
    if "tool" in asked:
        said = {"tool": asked["tool"]["enum"][text.count("[1]") + text.count("[2]")], "query": "the", "entity": "hot gear", "attribute": "", "reasoning": "r"}
    elif "sufficient" in asked:
        said = {"sufficient": "[2]" in text, "reasoning": "r"}
    else:
        said = {"answer": text.split("\n")[0], "citations": [{"doc_id": "d", "page": 3, "section": "s"}], "conflicts": ["a and b"]}
    return 200, json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]}).encode()
