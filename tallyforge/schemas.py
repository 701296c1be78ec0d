"""Schemas and the ordered verdict vocabulary."""

from __future__ import annotations

#: Verdicts and their scores, in order.
VERDICTS = ("absent", "partial", "present")
VERDICT_SCORE = {"absent": 0.0, "partial": 0.5, "present": 1.0}

JUDGEMENT = (
    "_seq long, event string, sitrep_id string, slot_id string, judge string, kind string, model string, arm string, "
    "date string, verdict string, confidence double, status string"
)
REPORT = (
    "id string, title string, source string, date string, day string, event string, url string, text string, "
    "model string, model_name string, arm string, collection string, file string, ingested_at string"
)
POST = ("tweet_id string, text string, class_label string, split string, event string, created_at string")
OPEN_CODES = (
    "sitrep_id string, event string, source string, status string, "
    "codes array<struct<name:string,definition:string,evidence_quote:string,location:string,confidence:string>>"
)
FIGURE = "array<struct<value:double,raw:string,unit:string,kind:string,keyword:string,start:int,end:int>>"
SPANS = "array<struct<label:string,start:int,end:int>>"
MANIFEST_COLUMNS = ("event", "title", "source", "date", "url", "file")
API_ITEM = (
    "id string, href string, fields struct<id:string,title:string,url:string,url_alias:string,body:string,body_html:string,"
    "date:struct<original:string,created:string>,source:array<struct<name:string,shortname:string>>,"
    "format:array<struct<name:string>>,disaster:array<struct<id:string,name:string,glide:string>>,"
    "primary_country:struct<iso3:string,name:string>,language:array<struct<code:string>>,"
    "file:array<struct<url:string,filename:string>>>"
)
