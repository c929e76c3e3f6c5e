"""Schemas of the library and of the tables on the way to it."""

FILE_SCHEMA = "original_path string, filename string, size_bytes long, modified_time timestamp_ntz, norm_path string, error string"

LOCATION = "struct<latitude:double,longitude:double,altitude:double,datum:string>"
EXIF = f"struct<camera_make:string,camera_model:string,f_stop:double,exposure_time:string,iso:int,focal_length:string,captured_at:timestamp_ntz,camera_profile:string,location:{LOCATION},flash_fired:boolean,focal_length_35mm:string,white_balance_mode:string,exposure_program:string,metering_mode:string,orientation:int,raw_tags:map<string,string>>"

LIBRARY_SCHEMA = f"file_hash string, doc_id long, norm_path string, file_info struct<name:string,path:string,size_bytes:long,mime_type:string>, dimensions struct<width:int,height:int>, exif {EXIF}, labels array<string>, added_at timestamp_ntz"

#: What the decoder adds to a file row.
DECODED = "file_hash string, width int, height int, tags map<string,string>, numbers map<string,array<double>>, decode_error string, error_type string"

PROFILES = ("unknown", "dslr", "mirrorless", "mobile", "action_cam", "film_scanner")
STATES = ("NEW", "MODIFIED", "UNCHANGED", "DELETED")
