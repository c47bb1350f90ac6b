"""Explicit schemas of the catalogue's tables and documents."""

from __future__ import annotations

TAG = "struct<tag:string,category:string,confidence:double>"
FACE = "struct<bbox:array<int>,face_id:string,name:string,confidence:double>"

MEDIA_ITEMS = (
    "id string, file_path string, file_name string, media_type string, file_size bigint, mtime double, duration double, media_date timestamp, phash string, "
    "status string, created_at timestamp, updated_at timestamp"
)
SYNC_HISTORY = "file_path string, file_size bigint, mtime double, status string, processed_at timestamp, sidecar_path string, error_message string"
FACE_REGISTRY = (
    "face_id string, person_id string, name string, embedding array<float>, image_path string, confidence double, source_file string, created_at timestamp, is_reference boolean"
)
MEDIA_TAGS = "media_id string, tag string, category string, confidence double"
TIMELINE = "media_id string, timestamp_start string, timestamp_end string, start_sec double, end_sec double, activity string, activity_ru string"
EMBEDDINGS = "media_id string, text_embedding array<float>, indexed_text string, created_at timestamp"

ANALYSIS = (
    "struct<summary:string,summary_ru:string,description:string,description_ru:string,environment:string,lighting:string,weather:string,time_of_day:string,ocr_text:string,"
    f"content_type:string,transcription:string,error:string,tags:array<{TAG}>,timeline_events:array<struct<timestamp_start:string,timestamp_end:string,activity:string,activity_ru:string>>>"
)
SIDECAR = (
    f"file_path string, file_name string, file_size bigint, mtime double, media_type string, content_type string, tags array<{TAG}>, "
    "exif struct<datetime:string,camera_make:string,camera_model:string,iso:int,exposure_time:string,f_number:string,gps:struct<latitude:double,longitude:double>,"
    "location:struct<city:string,region:string,country:string>>, "
    "video_metadata struct<duration:double,width:int,height:int,fps:double,bitrate:bigint,codec:string,datetime:string>, "
    f"phash string, faces array<{FACE}>, face_timeline map<string,struct<intervals:array<array<string>>,name:string>>, "
    f"gemini_analysis {ANALYSIS}, transcription string, modules_status struct<transcribe:boolean,faces:boolean,duplicates:boolean,vision:boolean>, _corrupt_record string"
)
