"""Lists and limits that must equal the published ones for right results."""

# Databases that belong to the platform itself.
SYSTEM_DATABASES = ["master", "msdb", "tempdb", "model"]

# Object kinds kept by the object collector.
OBJECT_KINDS = ["U", "V", "P", "FN", "IF", "TF", "C", "F", "SO"]
OBJECT_KINDS_NO_SEQUENCES = ["U", "V", "P", "FN", "IF", "TF", "C", "F"]

# Type ids of the integer columns that a sequence can feed (smallint, int, bigint).
SEQUENCE_TYPE_IDS = [52, 56, 127]

# Object kind code -> description.
KIND_DESCRIPTIONS = {
    "AF": "Aggregate function (CLR)",
    "C": "CHECK constraint",
    "D": "Default or DEFAULT constraint",
    "F": "FOREIGN KEY constraint",
    "FN": "Scalar function",
    "FS": "Assembly (CLR) scalar-function",
    "FT": "Assembly (CLR) table-valued function",
    "IF": "In-lined table-function",
    "IT": "Internal table",
    "L": "Log",
    "P": "Stored procedure",
    "PC": "Assembly (CLR) stored-procedure",
    "PK": "PRIMARY KEY constraint",
    "RF": "Replication filter stored procedure",
    "S": "System table",
    "SN": "Synonym",
    "SQ": "Service queue",
    "TA": "Assembly (CLR) DML trigger",
    "TF": "Table function",
    "TR": "SQL DML Trigger",
    "TT": "Table type",
    "U": "User table",
    "UQ": "UNIQUE constraint",
    "V": "View",
    "X": "Extended stored procedure",
}

# Kinds a distributed warehouse cannot hold.
INCOMPATIBLE_KINDS = ["TR", "TT", "X", "UQ", "AF", "FS", "FT", "IT", "F"]

# Column types a distributed warehouse cannot hold.
INCOMPATIBLE_TYPES = ["geography", "geometry", "hierarchyid", "sql_variant", "xml", "image"]

# Large text types; the second list also covers the spellings the collector writes.
LARGE_TEXT_TYPES = ["text", "ntext", "varchar(max)"]
LARGE_TEXT_TYPES_INTENDED = ["text", "ntext", "varchar (max)", "nvarchar (max)"]

# Row-count classes: upper limits of Small, Medium and Large.
SIZE_LIMITS = (6_000_000, 60_000_000, 1_000_000_000)

# Routine text patterns (LIKE syntax, compared without case).
FOR_XML_PATTERN = "%for xml%"
CURSOR_PATTERN = "%declare%cursor%"

# A default that calls a function.
CALL_DEFAULT_PATTERN = "%()%"

# Version text of a server that reports none, and the patterns of the generations.
UNKNOWN_VERSION = "Microsoft SQL Server 2000"
GENERATIONS = {
    "azure": "microsoft sql azure%",
    "2000": "microsoft sql server 2000%",
    "2005": "microsoft sql server 2005%",
    "2008": "microsoft sql server 2008%",
    "2012": "microsoft sql server 2012%",
}
CLOUD_PATTERN = "%azure%"

# Server versions (LIKE patterns).
GROUP_VERSIONS = ["%2012%", "%2014%", "%2016%", "%2017%", "%2019%"]
VOLUME_VERSIONS = ["%2008%", "%2012%", "%2014%", "%2016%", "%2017%", "%2019%"]

# The default instance's engine service.
ENGINE_SERVICE = "SQL Server (MSSQLSERVER)"

# Background waits that say nothing about load.
IGNORED_WAITS = [
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE", "CXPACKET", "DBMIRRORING_CMD", "DBMIRROR_DBM_EVENT",
    "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE", "DIRTY_PAGE_POLL",
    "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT", "FT_IFTSHC_MUTEX",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "HADR_CLUSAPI_CALL", "HADR_FILESTREAM_IOMGR_IOCOMPLETION",
    "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE", "HADR_TIMER_TASK", "HADR_WORK_QUEUE",
    "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "MEMORY_ALLOCATION_EXT",
    "ONDEMAND_TASK_QUEUE", "PREEMPTIVE_XE_DISPATCHER", "PREEMPTIVE_XE_GETTARGETSTATE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED", "PWAIT_DIRECTLOGCONSUMER_GETNEXT", "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_SHUTDOWN_QUEUE", "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH",
    "RESOURCE_QUEUE", "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP",
    "SLEEP_DCOMSTARTUP", "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED",
    "SLEEP_MSDBSTARTUP", "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT", "SOS_WORK_DISPATCHER", "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "SQLTRACE_WAIT_ENTRIES",
    "WAITFOR", "WAITFOR_TASKSHUTDOWN", "WAIT_FOR_RESULTS", "WAIT_XTP_CKPT_CLOSE",
    "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAIT_XTP_RECOVERY",
    "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT",
]

# Schedule codes.
WEEK_DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
RELATIVE_WEEKS = {1: "first ", 2: "second ", 4: "third ", 8: "fourth ", 16: "last "}
RELATIVE_DAY_KINDS = {8: "day", 9: "week day", 10: "weekend day"}
SUBDAY_UNITS = {2: "second(s)", 4: "minute(s)", 8: "hour(s)"}
FREQUENCY_NAMES = {1: "Once", 4: "Daily", 8: "Weekly", 16: "Monthly", 32: "Monthly relative"}
AUTO_START_NAME = "Execute when SQL Server Agent starts"
UNIT_NAMES = {1: "At the specified time", 2: "Seconds", 4: "Minutes", 8: "Hours"}
# Labels of our own for the two schedule kinds whose text the server itself supplies.
AUTO_START_LABEL = "When the agent starts"
ON_IDLE_LABEL = "When the processors are idle"

# Literal that stands for "empty" in each type family.
EMPTY_TEXT_LITERAL = "''"
EMPTY_NUMBER_LITERAL = "0"
EMPTY_BINARY_LITERAL = "0x"
EMPTY_GUID_LITERAL = "'00000000-0000-0000-0000-000000000000'"
EMPTY_DATE_LITERAL = "'01/01/1999'"
NUMBER_TYPES = ["bigint", "bit", "float", "int", "money", "smallint", "smallmoney", "tinyint"]
DATE_TYPES = ["date", "datetime", "smalldatetime"]
