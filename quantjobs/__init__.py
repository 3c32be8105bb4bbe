"""quantjobs: PySpark batch jobs for equity research and portfolio accounting."""
