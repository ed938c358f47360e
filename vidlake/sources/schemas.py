"""Schemas of the library's tables as DDL."""

from __future__ import annotations

BOX = "array<double>"
TRACKS = f"video_id string, frame_idx bigint, timestamp_s double, track_id bigint, bbox_xyxy {BOX}, det_score double, category_id int, source string, association_score double"
VIDEO_META = "video_id string, input_path string, fps double, width int, height int, frame_count bigint, processed_frames bigint, tracker string, tracker_config map<string,string>"
_ACTION = "array<struct<class_id:int,label:string,score:double>>"
ACTIONS = f"video_id string, frame_idx bigint, timestamp_s double, track_id bigint, bbox_xyxy {BOX}, det_score double, proposal_frame_idx bigint, proposal_frame_offset bigint, action_candidates {_ACTION}, selected_actions {_ACTION}, temporal_padding boolean"
IDENTITY_MAP = "raw_track_id bigint, person_id string, video_id string, identity_label string, status string, resolution_mode string, confidence double"
EVENTS = "video_id string, event_id string, id string, event string, start double, end double, raw_score double, start_frame bigint, end_frame bigint, raw_track_ids array<bigint>, support_count bigint, source string"
REFERENCE_EVENTS = EVENTS + f", actor_tube array<{BOX}>, reference_video_meta struct<fps:double,frame_count:bigint,height:int,width:int>"
READINGS = "raw_track_id bigint, frame_idx bigint, timestamp_s double, number string, rejection_reasons array<string>, usable boolean, evidence_eligible boolean, jersey_color string, view string"
NODES = "node_id string, clip_name string, raw_track_ids array<bigint>, intervals array<array<double>>, team_id string, jersey struct<number:string,support:int>, hold_reasons array<string>, sample_count int, evidence_kind string, source_video_id string, source_clip_start_s double"
STATES = "source_observation_s double, phase string, attacking_team string, window_id string, evidence string"
PROPOSALS = "time_range_s array<double>, kind string, needs_review boolean, window_id string, evidence string, transition string"
MOT = "frame bigint, id bigint, x double, y double, w double, h double, conf double, class int, visibility double"
AVA = "video string, timestamp int, x1 double, y1 double, x2 double, y2 double, action_id int, entity_id int"
