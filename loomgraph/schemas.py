"""Schemas of the tables."""
TRIPLE = "head string, relation string, tail string, confidence string, source_file string, track string, chunk_index int"
CONCEPT = "name string, description string, source_file string, confidence string, node_type string, extra map<string,string>"
EDGES = f"{TRIPLE}, seq long"
NODES = CONCEPT
CHUNKS = "source_file string, index int, text string, token_count int"
MANIFEST = (
    "path string, sha256 string, processed_at string, extractor_version string, llm_model string, embedding_model string, embedding_dim int, extraction_config string, index_config string, embedding_config string"
)
_T = ",".join(f"{n}:{t}" for n, t in (x.split() for x in TRIPLE.split(", ")))
_C = "name:string,description:string,source_file:string,confidence:string,node_type:string,extra:map<string,string>"
LOG = f"schema_version string, op string, source_file string, ts string, triples array<struct<{_T}>>, concepts array<struct<{_C}>>, seq long"
VECTORS = "id string, source_file string, node string, document string, embedding array<float>"
COMMUNITIES = "id int, members array<string>, size int, summary string, source_files array<string>"
KEYWORDS = "keyword string, node string, source_file string, node_type string"
HITS = f"pos long, source string, score double, triple struct<{_T}>, concept struct<{_C}>, community_summary string"
REVIEW = "question string, reason string, entities string, ts string, done boolean"
