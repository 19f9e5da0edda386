"""Explicit schemas of nested claim records, and adapters for their two dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

ENTITY = "struct<id:string,category_vi:string,classifier:string,number:struct<value:int,marker:string,countable:boolean>,gender:struct<value:string,evidence:string,backoff_neutralised:boolean>,confidence:double,detector:string,surface:string,bbox:array<double>,salience:double,coreference_group:string>"
ARGUMENT = "struct<entity_id:string,text_vi:string,head_noun_vi:string>"
PROBE = "struct<question_vi:string,answer:string,answer_prob:double,polarity:string,samples:array<string>,model:string>"
EVIDENCE = f"struct<probes:array<{PROBE}>,visual_grounding:struct<grounding_score:double,method:string>,external_knowledge:struct<requires_inference:boolean,inference_type:string>>"
VERIFICATION = "struct<status:string,explanation_vi:string,verifier:string,support_score:double,contradiction_score:double,evidence_sufficiency:double,channel_scores:map<string,double>,reject_sublabel:string>"
PROPOSITION = (
    f"struct<id:string,type:string,text_vi:string,subject:{ARGUMENT},predicate:struct<lemma_vi:string,polarity:string,aspect:string>,object:{ARGUMENT},"
    "attributes:array<struct<kind:string,value_vi:string>>,spatial_relation:struct<relation_vi:string,frame_of_reference:string>,"
    "count:struct<value:int,classifier:string,entity_category_vi:string,exact:boolean,tolerance:int>,confidence:double,specificity_level:int,"
    f"entails:array<string>,contradicts:array<string>,adversarial:boolean,evidence:{EVIDENCE},verification:{VERIFICATION}>"
)
CAPTION = "struct<text_vi:string,spans:array<struct<text:string,char_start:int,char_end:int,proposition_ids:array<string>,span_role:string,is_factual:boolean>>,ungrounded_spans:array<string>,hedged_spans:array<string>>"
RECORD_DDL = f"image_id string, file_name string, reference_captions array<string>, entities array<{ENTITY}>, propositions array<{PROPOSITION}>, selected_ids array<string>, hedged_ids array<string>, caption {CAPTION}, image struct<image_id:string>, selection struct<selected_ids:array<string>,uncertain_admitted_ids:array<string>>"


def record_schema() -> T.StructType:
    return T.StructType.fromDDL(RECORD_DDL)


def unify_dialects(records: DataFrame) -> DataFrame:
    """One layout for records that keep ids at the top and documents that keep them under image and selection."""
    return records.withColumns(
        {
            "image_id": F.coalesce("image_id", "image.image_id"),
            "selected_ids": F.coalesce("selected_ids", "selection.selected_ids"),
            "hedged_ids": F.coalesce("hedged_ids", "selection.uncertain_admitted_ids"),
        }
    ).drop("image", "selection")
