"""Schemas of the persistent tables."""

from __future__ import annotations

EDGES = "subject string, object string, predicate_code smallint, knowledge_level string, agent_type string, primary_knowledge_source string"
PREDICATES = "predicate_code smallint, predicate string, n_edges_kept bigint"
NODES = "id string, name string, category string, all_categories array<string>"
EQUIVALENTS = "curie string, canonical_id string"
DEGREES = "node string, degree bigint"
NODE_DETAILS = "id string, description string, iri string, synonyms array<string>, publications array<string>"
EDGE_PUBLICATIONS = "subject string, predicate string, object string, publications array<string>"
GENE_TERMS = "gene string, go string, predicate string"
NAMES = "name_lc string, category string, n bigint"
EXEMPLARS = "class string, exemplar string, form string, depth int, parent string"
NODE_DUMP = "id string, name string, category string, all_categories array<string>, equivalent_curies array<string>, description string, iri string, all_names array<string>, publications array<string>"
EDGE_DUMP = "subject string, object string, predicate string, primary_knowledge_source string, knowledge_level string, agent_type string, publications array<string>"
SAMPLES = "t double, pipeline_rss_mb double, model_rss_mb double, system_used_mb double, gpu_mib int, models string"
