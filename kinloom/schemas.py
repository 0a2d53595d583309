"""Declared schemas of the register tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "dates": T.ArrayType(T.DateType()),
    "codes": T.ArrayType(T.StringType()),
    "vector": T.ArrayType(T.FloatType()),
    "people": T.ArrayType(T.StructType().add("name", T.StringType()).add("residence", T.StringType())),
}


def _schema(text: str) -> T.StructType:
    """Schema of ``a, b: type; c: type`` groups."""
    schema = T.StructType()
    for group in text.split(";"):
        names, _, kind = group.partition(":")
        for name in names.split(","):
            schema.add(name.strip(), _TYPES[kind.strip()])
    return schema


_TEXTS = "original_text_latin, transcription, translation, notes: string"
_STAMPS = "created_at, updated_at: timestamp"
_SPOUSE = (
    "spouse1_{0}, spouse2_{0}: string"
)

TABLES = {
    "record_batches": _schema("id, source, description: string; ingested_at: timestamp"),
    "genealogical_records": _schema(
        "id, batch_id, record_type, raw_payload, external_id: string; created_at: timestamp"
    ),
    "uploaded_files": _schema(
        "id, filename, original_filename, filepath: string; file_size: bigint; mime_type: string;"
        " uploaded_at: timestamp; batch_id, processing_status: string"
    ),
    "social_statuses": _schema("id, latin_name, polish_name, description: string; created_at: timestamp"),
    "persons": _schema(
        "id, gedcom_id, source_batch_id, first_name, last_name, maiden_name, gender: string;"
        " birth_date: date; birth_date_estimated: boolean; death_date: date; death_date_estimated: boolean;"
        " birth_place, death_place, residence, house_number, parish, father_id, mother_id, social_status_id,"
        " occupation, notes: string;" + _STAMPS + "; embedding: vector;"
        " first_name_phonetic, last_name_phonetic, maiden_name_phonetic: codes"
    ),
    "baptism_records": _schema(
        "id, gedcom_id, source_batch_id, record_number, page_number: string; birth_date, baptism_date: date;"
        " parish, village, house_number, child_id, child_name, child_gender, father_id, father_name,"
        " father_surname, mother_id, mother_name, mother_maiden_name: string; legitimate: boolean;"
        " paternal_grandfather_name, paternal_grandmother_name, maternal_grandfather_name,"
        " maternal_grandmother_name, godfather_name, godmother_name, godparents_location, priest_name: string;"
        + _TEXTS + ";" + _STAMPS + "; embedding: vector;"
        " child_name_phonetic, father_surname_phonetic, mother_maiden_name_phonetic: codes"
    ),
    "marriage_records": _schema(
        "id, gedcom_id, source_batch_id, record_number, page_number: string; marriage_date: date;"
        " parish, village: string;"
        + ";".join(
            _SPOUSE.format(c)
            for c in ("id", "name", "surname", "status", "parish", "residence", "father_name", "mother_name")
        )
        + "; spouse1_age, spouse2_age: int; spouse2_maiden_name: string; banns_count: int;"
        " banns_dates: dates; witnesses: people;"
        " priest_name: string;" + _TEXTS + ";" + _STAMPS + "; embedding: vector;"
        " spouse1_surname_phonetic, spouse2_surname_phonetic: codes"
    ),
    "death_records": _schema(
        "id, gedcom_id, source_batch_id, record_number, page_number: string; death_date, burial_date: date;"
        " parish, village, cemetery, deceased_id, deceased_name, deceased_surname, deceased_maiden_name,"
        " marital_status: string; age_years: int; age_description, cause_of_death: string;"
        " sacraments_received: boolean; sacraments_details, spouse_name, father_name, mother_name,"
        " priest_name: string;" + _TEXTS + ";" + _STAMPS + "; embedding: vector;"
        " deceased_surname_phonetic, deceased_maiden_name_phonetic: codes"
    ),
    "godparent_relationships": _schema(
        "id, baptism_record_id, godparent_id, godparent_type: string; created_at: timestamp"
    ),
    "witness_relationships": _schema(
        "id, marriage_record_id, witness_id: string; witness_order: int; created_at: timestamp"
    ),
    "duplicate_candidates": _schema(
        "id, record_type, record1_id, record2_id: string; vector_similarity, phonetic_similarity,"
        " date_similarity, location_similarity, composite_score: double; status, reviewed_by: string;"
        " reviewed_at: timestamp; review_notes: string; detected_at: timestamp; detection_method: string"
    ),
    "duplicate_resolutions": _schema(
        "id, candidate_id, action, kept_record_id, merged_record_id, resolved_by: string;"
        " resolved_at: timestamp; resolution_notes, merged_data: string"
    ),
}
