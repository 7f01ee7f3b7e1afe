"""Explicit types of every table the jobs read and write."""

from pagewarden import lexicon

COOKIE = ("struct<name:string,domain:string,path:string,secure:boolean,"
          "httpOnly:boolean,sameSite:string>")
SCRIPT = "struct<src:string,category:string>"
FORM = ("struct<action:string,method:string,fields:array<string>,"
        "has_nearby_privacy_notice:boolean>")
FLAGS = "struct<" + ",".join(f"{f}:boolean" for f in lexicon.POLICY_ELEMENTS) + ">"

# One loaded page; cookies are those seen before any consent.
CRAWL = ("page_id bigint, url string, final_url string, status int, html string, "
         f"error string, cookies array<{COOKIE}>, fetched_at timestamp")
RULE = ", ".join(f"`{f}` string" for f in lexicon.RULE_FIELDS)
WEBSITES = "website_id bigint, url string, domain string, created_at timestamp"
SCAN_RUNS = ("scan_run_id bigint, website_id bigint, report_ref string, "
             "started_at timestamp, finished_at timestamp, status string, "
             "error_message string")
FINDINGS = ("finding_id bigint, scan_run_id bigint, rule_id string, category string, "
            "description string, recommendation string, evidence_json string, "
            "status string, created_at timestamp")
COMPANIES = ("company_id bigint, website_id bigint, name string, legal_name string, "
             "nif string, address string, registry_verified boolean, note string, "
             "nameservers_json string, created_at timestamp, updated_at timestamp")
NOTIFICATIONS = ("notification_id bigint, client_id int, device_id int, "
                 "remote_address string, device_name string, category string, "
                 "notification_key string, level int, log_timestamp timestamp, "
                 "description string, type string, created_at timestamp")
COMPANY_INPUT = ("company_name string, legal_name string, country string, "
                 "address string")
