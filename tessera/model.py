"""SKOS vocabulary constants.

FIXED VALUES: property names, prefixes and term kinds below follow the W3C
SKOS reference and must equal the reference tool's output for matching TTL.
"""

from __future__ import annotations

# SKOS properties in the order they are written (labels, notation,
# documentation, semantic relations, mapping relations).
SKOS_PROPERTIES = [
    "prefLabel", "altLabel", "hiddenLabel",
    "notation",
    "note", "changeNote", "definition", "editorialNote", "example", "historyNote", "scopeNote",
    "broader", "narrower", "related", "broaderTransitive", "narrowerTransitive", "semanticRelation",
    "broadMatch", "closeMatch", "exactMatch", "mappingRelation", "narrowMatch", "relatedMatch",
]

# Properties whose values are URIs (written as <...>).
URI_PROPERTIES = [
    "broader", "narrower", "related", "broaderTransitive", "narrowerTransitive", "semanticRelation",
    "broadMatch", "closeMatch", "exactMatch", "mappingRelation", "narrowMatch", "relatedMatch",
]

# Literal properties the cleaner parses (label and documentation kinds).
LITERAL_PROPERTIES = [
    "prefLabel", "altLabel", "hiddenLabel", "definition", "note", "scopeNote",
    "editorialNote", "historyNote", "changeNote", "example",
]

# URI-valued statements the cleaner keeps from a concept block.
RELATION_PROPERTIES = [
    "exactMatch", "narrower", "broader", "broaderTransitive", "related", "closeMatch",
    "broadMatch", "narrowMatch", "relatedMatch", "inScheme", "topConceptOf", "hasTopConcept",
    "member", "memberList",
]

# Standard prefixes written into a TTL header, in order.
PREFIXES = [
    ("skos", "http://www.w3.org/2004/02/skos/core#"),
    ("dct", "http://purl.org/dc/terms/"),
    ("xsd", "http://www.w3.org/2001/XMLSchema#"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("esco", "http://data.europa.eu/esco/skill/"),
    ("isced", "http://data.europa.eu/esco/isced-f/"),
    ("isothes", "http://purl.org/iso25964/skos-thes#"),
]

PROPERTY_RANK = {p: i for i, p in enumerate(SKOS_PROPERTIES)}
