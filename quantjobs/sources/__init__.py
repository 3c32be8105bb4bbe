"""quantjobs.sources"""
