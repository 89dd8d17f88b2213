"""Schemas of the tables that operators exchange."""

NODE = "id string, name string, node_type string, description string, aliases array<string>, types array<string>, embedding array<double>"
EDGE = "edge_id string, source string, target string, relation string"
STEP = "prompt_id string, step_index int, text string, explicit boolean, reason string"
DEPENDENCY = "prompt_id string, seq int, before string, after string"
CANDIDATE = "prompt_id string, step_index int, rank int, node_id string, name string, node_type string, score double, lexical_score double, semantic_score double, explicit boolean, inferred boolean, source string, prompt_text string, relation_score double"
CONTEXT_EDGE = "prompt_id string, source string, target string, relation string, origin string, edge_type string, weight double, classification string, traverses_for_ordering boolean"
FUNCTION = "name string, description string, inputs array<string>, outputs array<string>"
RAW_RECORD = "struct<id:string,name:string,statement:string>"
RAW_RELATIONSHIP = "struct<source:string,target:string,type:string,raw_type:string,condition:string>"
ONTOLOGY = "version string, node_types map<string,string>, relationships array<struct<type:string,raw_terms:array<string>,source_types:array<string>,target_types:array<string>>>"
INTERPRETATION = "intent string, explicit_steps array<struct<text:string,reason:string>>, inferred_steps array<struct<text:string,reason:string>>, dependencies array<struct<before:string,after:string>>"
