"""Sources and sinks: binary vector files, the mutation log, snapshots."""
