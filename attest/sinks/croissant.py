"""A dataset card as Croissant 1.1 JSON-LD: files with digests, typed columns with units, and the claims."""

from __future__ import annotations

import json
import os
from typing import Any

from .project import Project, slug
from .triples import PREFIXES

NS = PREFIXES["at"]

# The JSON-LD context that Croissant 1.1 prescribes.
CONTEXT = {
    "@language": "en",
    "@vocab": "https://schema.org/",
    "citeAs": "cr:citeAs",
    "column": "cr:column",
    "conformsTo": "dct:conformsTo",
    "containedIn": "cr:containedIn",
    "cr": "http://mlcommons.org/croissant/",
    "rai": "http://mlcommons.org/croissant/RAI/",
    "data": {"@id": "cr:data", "@type": "@json"},
    "dataType": {"@id": "cr:dataType", "@type": "@vocab"},
    "dct": "http://purl.org/dc/terms/",
    "examples": {"@id": "cr:examples", "@type": "@json"},
    "extract": "cr:extract",
    "field": "cr:field",
    "fileProperty": "cr:fileProperty",
    "fileObject": "cr:fileObject",
    "fileSet": "cr:fileSet",
    "format": "cr:format",
    "includes": "cr:includes",
    "isLiveDataset": "cr:isLiveDataset",
    "jsonPath": "cr:jsonPath",
    "key": "cr:key",
    "md5": "cr:md5",
    "parentField": "cr:parentField",
    "path": "cr:path",
    "prov": "http://www.w3.org/ns/prov#",
    "recordSet": "cr:recordSet",
    "references": "cr:references",
    "regex": "cr:regex",
    "repeated": "cr:repeated",
    "replace": "cr:replace",
    "sc": "https://schema.org/",
    "samplingRate": "cr:samplingRate",
    "separator": "cr:separator",
    "source": "cr:source",
    "subField": "cr:subField",
    "transform": "cr:transform",
}
_CLAIM = {
    "x": "x", "y": "y", "x_unit": "xUnit", "y_unit": "yUnit", "cross_dataset": "crossDataset", "method": "method", "claimed": "claimed", "estimate": "estimate",
    "ci_lo": "ciLow", "ci_hi": "ciHigh", "n_units": "nUnits", "verdict": "verdict", "status": "status", "why": "why",
}
_EVIDENCE = {"source": "evidenceSource", "locator": "evidenceLocator", "extracted_by": "extractedBy"}


def _files(p: Project, out_dir: str) -> list[dict[str, Any]]:
    found = []
    for d in p.catalog.datasets.values():
        for f in d.files:
            # Readers resolve a relative address against the card's own folder.
            entry = {
                "@type": "cr:FileObject",
                "@id": slug(os.path.basename(f)),
                "name": slug(os.path.basename(f)),
                "contentUrl": os.path.relpath(p.catalog.path(f), out_dir),
                "encodingFormat": "text/csv",
                "sha256": p.files[f].sha256,
                f"{NS}origin": d.origin,
            }
            if d.origin == "manual":
                entry |= {f"{NS}manualSource": d.source, f"{NS}retrieved": d.retrieved, f"{NS}pinnedSha256": d.sha256}
            found.append(entry)
    return found


def _record_sets(p: Project) -> list[dict[str, Any]]:
    sets = []
    for d in p.catalog.datasets.values():
        file_id = slug(os.path.basename(d.files[0]))
        name = f"{file_id}_records"
        fields = []
        for (where, column), v in p.catalog.variables.items():
            if where != d.id:
                continue
            entry: dict[str, Any] = {
                "@type": "cr:Field",
                "@id": f"{name}/{column}",
                "name": column,
                "description": v.description,
                "dataType": p.types.get((d.id, column), "sc:Text"),
                "source": {"fileObject": {"@id": file_id}, "extract": {"column": column}},
            }
            if v.unit is not None:
                entry |= {f"{NS}unit": v.unit, f"{NS}unitSystem": "UDUNITS-2"}
            fields.append(entry)
        if fields:
            entry = {"@type": "cr:RecordSet", "@id": name, "name": name, f"{NS}dataset": d.id, "field": fields}
            sets.append(entry | ({"description": d.title.strip()} if d.title else {}))
    return sets


def build(p: Project, out_dir: str | None = None) -> dict[str, Any]:
    """The card as it reads from ``out_dir`` (the project's folder, if not given)."""
    about = p.about
    told = {"license": "license", "version": "version", "date_published": "datePublished", "citation": "citation"}
    claims = [{new: r.get(old) for old, new in _CLAIM.items()} | {new: r.get("evidence", {}).get(old) for old, new in _EVIDENCE.items()} for r in p.claims["relationships"]]
    return {
        "@context": CONTEXT | {"at": NS},
        "@type": "sc:Dataset",
        "conformsTo": "http://mlcommons.org/croissant/1.1",
        "name": about["name"],
        "description": about.get("title", about["name"]),
        f"{NS}context": about.get("context", "").strip(),
        **{new: about[old] for old, new in told.items() if about.get(old)},
        "distribution": _files(p, out_dir or p.root),
        "recordSet": _record_sets(p),
        f"{NS}joins": p.claims.get("joins", []),
        f"{NS}claims": claims,
    }


def render(p: Project, out_dir: str | None = None) -> str:
    return json.dumps(build(p, out_dir), indent=2) + "\n"
