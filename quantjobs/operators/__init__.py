"""quantjobs.operators"""
