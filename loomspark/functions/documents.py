"""Data within JSON documents and pages: values by key, lists of records, embedded data, the next page."""

from __future__ import annotations

import json
import re
from collections import Counter, deque
from urllib.parse import urljoin

from pyspark.sql import Column

from loomspark.functions import html as H
from loomspark.functions.columns import mapped


def _loads(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def find_values(text: str | None, key: str) -> list[str]:
    """The values under ``key`` anywhere in a JSON document, each as JSON, in the order of the document."""
    out: list[str] = []
    stack = [_loads(text)]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):  # a field
            name, node = node
            if name == key:
                out.append(json.dumps(node, ensure_ascii=False))
        if isinstance(node, dict):
            stack.extend(reversed(list(node.items())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return out


def json_collections(text: str | None, least: int = 2) -> list[dict]:
    """``{path, records, fields}`` of the lists of records in a JSON document, those with most values first.

    A list counts when ``least`` of its items, and four in five, are objects. Lists of one path, and
    those within the records of one list, are taken together; ``edges[].node`` is read through. Maps
    keyed by ids are read as records of their fields.
    """
    found: list[dict] = []
    todo: deque = deque([("", [_loads(text)])])
    while todo:
        path, values = todo.popleft()
        groups = [(path, [v for v in values if isinstance(v, dict)])]
        items = [x for v in values if isinstance(v, list) for x in v]
        records = [x for x in items if isinstance(x, dict)]
        if records and len(records) >= least and 5 * len(records) >= 4 * len(items):
            at = f"{path}[]"
            if all(isinstance(r.get("node"), dict) for r in records):
                at, records = f"{at}.node", [r["node"] for r in records]
            fields = Counter(k for r in records for k in r)
            found.append({"path": at, "records": len(records), "fields": [k for k, _ in fields.most_common()]})
            groups.append((at, records))
        elif items:
            todo.append((f"{path}[]", items))
        for at, objects in groups:
            for k in dict.fromkeys(k for o in objects for k in o):
                inner = [o[k] for o in objects if isinstance(o.get(k), (dict, list))]
                if inner:
                    todo.append((f"{at}.{k}".lstrip("."), inner))
    return sorted(found, key=lambda c: (-c["records"] * len(c["fields"]), c["path"]))


_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.I | re.S)
_JSON_TYPE = re.compile(r"""\btype\s*=\s*["']?application/json\b""", re.I)
_ID = re.compile(r"""\bid\s*=\s*["']?([\w:.-]+)""", re.I)
_ASSIGNED = re.compile(r"(?:^|[;\s])(?:window\.|self\.|var\s+|let\s+|const\s+)?(__?[A-Za-z]\w*|[A-Z][A-Z_]{3,})\s*=\s*(?=[{\[])")


def embedded_json(html: str | None) -> list[dict]:
    """``{name, data}`` of the JSON that a page carries for its scripts: data elements and assigned variables.

    ``name`` is the element's id or the variable; what can't be read as JSON is left out.
    """
    out: list[dict] = []
    for m in _SCRIPT.finditer(html or ""):
        attributes, body = m[1], m[2]
        if _JSON_TYPE.search(attributes):
            data = _loads(body.strip())
            if data is not None:
                name = _ID.search(attributes)
                out.append({"name": name[1] if name else None, "data": json.dumps(data, ensure_ascii=False)})
            continue
        for a in _ASSIGNED.finditer(body):
            try:
                data, _ = json.JSONDecoder().raw_decode(body, a.end())
            except ValueError:
                continue
            out.append({"name": a[1], "data": json.dumps(data, ensure_ascii=False)})
    return out


#: Texts of links to the next page.
NEXT = frozenset("next|next page|next »|next ›|next >|older|older posts|weiter|nächste|nächste seite|suivant|page suivante|siguiente|página siguiente|successiva|avanti|próxima|próximo|volgende|następna|nästa|далее|следующая|次へ|»|›|→|>".split("|"))
_NEXT_REL = re.compile(r"""<(?:a|link)\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bnext\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def next_page(html: str | None, url: str | None = None) -> str | None:
    """The address of the next page: by ``rel=next``, else by the text of a link; null for none, or the page itself."""
    if not html:
        return None
    m = _NEXT_REL.search(html)
    href = next((g for g in m.groups() if g), None) if m else None
    if href is None:
        href = next((x["href"] for x in H.links(H.parse(html), url) if re.sub(r"\s+", " ", x["text"] or "").strip().casefold() in NEXT), None)
    if not href:
        return None
    full = urljoin(url, href) if url else href
    return None if full == url else full


def find_values_col(c: Column, key: str) -> Column:
    return mapped(lambda t: find_values(t, key), "array<string>")(c)


def collections_col(c: Column) -> Column:
    return mapped(json_collections, "array<struct<path:string,records:bigint,fields:array<string>>>")(c)


def embedded_col(c: Column) -> Column:
    return mapped(embedded_json, "array<struct<name:string,data:string>>")(c)
