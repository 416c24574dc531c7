"""Schemas of the stored tables; applied on read, never inferred."""

SHOTS = "video_id string, shot_id bigint, start_frame bigint, end_frame bigint, start_ms bigint, end_ms bigint"
KEYFRAMES = (
    "video_id string, keyframe_id string, shot_id bigint, frame_index bigint, time_ms bigint, pts bigint, time_base string, time_source string, "
    "image string, sharpness double, brightness double, entropy double, dhash string, rejected string, group_no bigint, indexed boolean"
)
VIDEOS = "video_id string, youtube_id string, url string, title string, channel string, published string, length_s bigint, fps string, frames bigint, width bigint, height bigint"
READINGS = "keyframe_id string, lines array<struct<text: string, score: double, box: array<double>>>"
SEGMENTS = "start_ms bigint, end_ms bigint, text string"
DETECTIONS = "keyframe_id string, objects array<struct<label: string, score: double, box: array<double>>>"
VECTORS = "id bigint, vector array<float>, keyframe_id string, video_id string, shot_id bigint, frame_index bigint, time_ms bigint"
LOG = "evaluation string, task string, answer string, verdict string"
