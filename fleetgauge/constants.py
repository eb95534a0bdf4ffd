"""Limits, default metric selections, labels and process patterns."""

from __future__ import annotations

# Limits.
HISTORY_SIZE = 40
MAX_POINTS = 500
MESSAGE_LIMIT = 120
MESSAGE_KEEP = 117

# Poll intervals in seconds (default, lowest, highest).
POLL_INTERVALS = {
    "process": (1.0, 1.5, 10.0),
    "spark": (1.0, 1.0, 60.0),
    "flink": (5.0, 1.0, 60.0),
    "timeline": (5.0, 2.0, 60.0),
}

# Timeline metric keys and labels.
TIMELINE_LABELS = {
    "lustre_io": "Lustre IO",
    "lustre_io_meta": "Lustre IO Meta",
    "horse_read_bw": "FS Horse Read BW",
    "horse_write_bw": "FS Horse Write BW",
    "octopus_read_bw": "FS Octopus Read BW",
    "octopus_write_bw": "FS Octopus Write BW",
    "horse_read_requests": "FS Horse Read Requests",
    "horse_write_requests": "FS Horse Write Requests",
    "octopus_read_requests": "FS Octopus Read Requests",
    "octopus_write_requests": "FS Octopus Write Requests",
    "read_bw": "Read BW",
    "write_bw": "Write BW",
    "cpu_usage": "CPU Usage",
    "mem_used": "Memory Used",
    "ipc": "IPC",
    "flops": "FLOPS",
    "mem_bw": "Memory BW",
    "infiniband_bw": "InfiniBand BW",
    "gpu_usage": "GPU Usage",
    "gpu_power": "GPU Power",
    "gpu_mem": "GPU Memory",
    "gpu_temperature": "GPU Temperature",
    "gpu_flops": "GPU FLOPS",
    "gpu_flops_any": "GPU FLOPS Any",
    "gpu_flops_16": "GPU FLOPS 16",
    "gpu_flops_32": "GPU FLOPS 32",
    "gpu_flops_64": "GPU FLOPS 64",
    "gpu_flops_tensor": "GPU FLOPS Tensor",
    "cpu_power": "CPU Power",
    "job_mem_used": "Job Memory Used",
    "ethernet_bw": "Ethernet BW",
}

# Application snapshot fields and labels, in field order.
SPARK_LABELS = {
    "active_jobs": "Active Jobs",
    "completed_jobs": "Completed Jobs",
    "failed_jobs": "Failed Jobs",
    "active_stages": "Active Stages",
    "completed_stages": "Completed Stages",
    "failed_stages": "Failed Stages",
    "active_tasks": "Active Tasks",
    "completed_tasks": "Completed Tasks",
    "failed_tasks": "Failed Tasks",
    "executor_count": "Executors",
    "total_cores": "Total Cores",
    "total_memory_mb": "Memory Used (MB)",
    "total_disk_usage_mb": "Disk Usage (MB)",
    "total_input_mb": "Input (MB)",
    "total_shuffle_read_mb": "Shuffle Read (MB)",
    "total_shuffle_write_mb": "Shuffle Write (MB)",
    "total_gc_time_ms": "GC Time (ms)",
    "total_duration_ms": "Execution Time (ms)",
    "jvm_heap_used_mb": "JVM Heap Used (MB)",
}

# Cluster snapshot fields and labels, in field order.
FLINK_LABELS = {
    "total_jobs": "Total Jobs",
    "running_jobs": "Running Jobs",
    "failed_jobs": "Failed Jobs",
    "finished_jobs": "Finished Jobs",
    "cancelled_jobs": "Cancelled Jobs",
    "total_tasks": "Total Tasks",
    "running_tasks": "Running Tasks",
    "failed_tasks": "Failed Tasks",
    "finished_tasks": "Finished Tasks",
    "cancelled_tasks": "Cancelled Tasks",
    "total_slots": "Total Slots",
    "used_slots": "Used Slots",
    "free_slots": "Free Slots",
    "task_managers": "Task Managers",
    "total_memory_mb": "Memory (MB)",
    "total_network_memory_mb": "Network Memory (MB)",
    "total_jvm_memory_mb": "JVM Memory (MB)",
}

# Process fields and labels, in field order. The two IO counters
# are cumulative MiB, so their labels say so.
PROCESS_LABELS = {
    "cpu": "CPU Usage (%)",
    "mem_pct": "Memory (%)",
    "mem_rss": "Memory (MB)",
    "mem_vms": "Virtual Memory (MB)",
    "threads": "Threads Count",
    "io_read": "IO Read (MB)",
    "io_write": "IO Write (MB)",
}

LABELS = {
    "timeline": TIMELINE_LABELS,
    "spark": SPARK_LABELS,
    "flink": FLINK_LABELS,
    "process": PROCESS_LABELS,
}

# Application metrics shown by default.
SPARK_ENABLED = [
    "total_memory_mb",
    "total_disk_usage_mb",
    "total_shuffle_read_mb",
    "total_shuffle_write_mb",
    "total_gc_time_ms",
    "total_duration_ms",
    "jvm_heap_used_mb",
]

# Process patterns per framework, in matching order.
PROCESS_PATTERNS = {
    "spark": [
        ("Master", "org.apache.spark.deploy.master.Master --host"),
        ("Worker", "org.apache.spark.deploy.worker.Worker --webui-port"),
        ("SparkSubmit", "org.apache.spark.deploy.SparkSubmit"),
        ("Executor", "org.apache.spark.executor.CoarseGrainedExecutorBackend"),
        ("Scheduler",
         "org.apache.spark.scheduler.cluster.CoarseGrainedSchedulerBackend"),
    ],
    "flink": [
        ("Master",
         "org.apache.flink.runtime.entrypoint.StandaloneSessionClusterEntrypoint"),
        ("Worker", "org.apache.flink.runtime.taskexecutor.TaskManagerRunner"),
        ("TaskManager", "org.apache.flink.runtime.taskexecutor.TaskManagerRunner"),
    ],
}

# Lower bounds, reserved worker share and memory step of a plan.
MIN_CORES = 1
MIN_MEMORY_MB = 1000
DEFAULT_WORKER_CORES = 1
DEFAULT_WORKER_MEMORY_MB = 1000
MEMORY_STEP_MB = 128

# Fixed texts: what is told of a cluster without workers, and titles of allocation cards.
NO_WORKERS = "no workers configured"
JOB_CARD = ("Job Allocation", "Slurm Job")
NODE_CARD = ("Physical Node", "Node ID: ")
COORDINATOR_CARD = ("Process", "Coordinator")
POOL_CARD = ("", "Resource Pool")
UNIT_CARD = ("Process", "Compute Unit")
