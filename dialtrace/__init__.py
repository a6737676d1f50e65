"""SIP signalling analytics on Spark DataFrames.

The functions that answer questions over the stored tables:

    search(capture, **fields)           one page of matching calls or messages
    search_document(capture, **fields)  the same as one JSON document
    call_flow(capture, id)              the flow a message belongs to
    call_flows(capture)                 all flows
    export_flow(capture, id)            a flow with its messages as one JSON document
    message(capture, id)                one rendered message
    dashboard(capture, sdp, type, days) content of a dashboard
"""

from dialtrace.plans.callflow import call_flow, call_flows, export_flow, export_flows, message
from dialtrace.plans.dashboards import dashboard
from dialtrace.plans.ingest import to_capture, to_sdp
from dialtrace.plans.search import search, search_document
from dialtrace.sources.pcap import index_savefiles, indexed_packets, read_savefiles, write_savefiles

__all__ = [
    "call_flow", "call_flows", "dashboard", "export_flow", "export_flows", "index_savefiles", "indexed_packets", "message",
    "read_savefiles", "search", "search_document", "to_capture", "to_sdp", "write_savefiles",
]
