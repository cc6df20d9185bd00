"""Declared schemas. Nothing is inferred."""

from __future__ import annotations

CHUNK = "id string, text string, doc_name string, section string, page int, control_id string, parent_id string, content_hash string"
MANIFEST = "identity string, hash string, page_count int, chunk_count int"
CHUNK_OUT = "id string, rank int, document string, section string, physical_page int, control_id string, text string, dense_cosine_score double, rrf_score double, rerank_score double, used_for_generation boolean, matched_evidence_indices array<int>"
CRITERION = "struct<score:int,justification:string>"
JUDGMENT = f"struct<correctness:{CRITERION},completeness:struct<score:int,justification:string,missing_claim_ids:array<string>>,faithfulness:struct<score:int,justification:string,unsupported_claims:array<string>,contradicted_claims:array<string>>,relevance:{CRITERION},verdict:string>"
COSINE = "struct<score:double,threshold:double,passed:boolean,selected_reference:string,selected_reference_index:int>"
BERTSCORE = "struct<precision:double,recall:double,f1:double,threshold:double,passed:boolean,selected_reference:string,selected_reference_index:int>"
JUDGE = f"struct<provider:string,model:string,prompt_version:string,prompt_hash:string,cache_key:string,cache_hit:boolean,judgment:{JUDGMENT}>"
STAGES = ("rewrite", "retrieval", "generation", "judge", "total")
RESULT = f"""schema_version int, run_id string, dataset_version string, question_id string, question string, candidate_model string, candidate_model_digest string,
generation_config map<string,string>, rewritten_query string, generated_answer string, reference_answer string, reference_answers array<string>,
gold_claims array<struct<id:string,text:string>>, gold_evidence array<struct<document_path:string,section:string,printed_page:string,pdf_page_index:int,text:string>>,
retrieved_chunks array<struct<id:string,rank:int,document:string,section:string,physical_page:int,text:string,used_for_generation:boolean,matched_evidence_indices:array<int>>>,
metrics struct<cosine_similarity:{COSINE},bertscore:{BERTSCORE},llm_judge:{JUDGE}>,
latency_ms struct<{",".join(f"{s}:double" for s in STAGES)}>, errors array<struct<stage:string,type:string,message:string>>"""
