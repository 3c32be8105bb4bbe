"""quantjobs.functions"""
